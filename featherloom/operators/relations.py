"""Small relational helpers shared by several workflows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stack(frames: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """Union of frames by column name, with the frame's name in ``source``."""
    named = [df.withColumn(source, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come once, from the left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys])
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def one_per_key(table: DataFrame, keys: Sequence[str], value: str, order: Column | str | None = None) -> DataFrame:
    """A dictionary with one row per key: the value of the highest ``order``, else the smallest value."""
    kept = F.max_by(value, F.col(order) if isinstance(order, str) else order) if order is not None else F.min(value)
    return table.groupBy(*keys).agg(kept.alias(value))


def split_stacked(df: DataFrame, name: str, source: str = "source") -> DataFrame:
    return df.where(F.col(source) == name)
