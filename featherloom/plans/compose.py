"""Chains of transforms. A chain only builds one lazy plan; nothing runs between its steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pyspark.sql import DataFrame

Step = tuple[Callable[..., DataFrame], Mapping]


def compose(steps: Sequence[Step]) -> Callable[[DataFrame], DataFrame]:
    """``[(operator, keyword arguments), ...]`` as one function of a frame, applied in order."""
    def run(df: DataFrame) -> DataFrame:
        for op, params in steps:
            df = df.transform(op, **params)
        return df
    return run
