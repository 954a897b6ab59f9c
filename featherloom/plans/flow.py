"""Declared multi-stage column flows.

A flow is a list of stages; a stage is a list of ``(operation name, arguments)``. Operations that
need statistics are fitted on the input of their stage, once, before the stage runs. A fitted flow
is a pure function of a frame, so it also applies to streams and to new chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from featherloom.functions import dates, scalars, textrules
from featherloom.operators import columns, encode, filters

Transform = Callable[[DataFrame], DataFrame]
Stage = Sequence[tuple[str, Sequence]]

# name -> function(df of the stage input, arguments) -> transform
OPERATIONS: dict[str, Callable[[DataFrame, Sequence], Transform]] = {}


def operation(name: str):
    def register(build):
        OPERATIONS[name] = build
        return build
    return register


def _each(make: Callable[..., Column]):
    """One column to one column; an argument is a name or a tuple (name, parameters...)."""
    def build(_: DataFrame, args: Sequence) -> Transform:
        specs = [a if isinstance(a, tuple) else (a,) for a in args]
        return lambda df: df.withColumns({s[0]: make(s[0], *s[1:]) for s in specs})
    return build


def _derive(make: Callable[..., Column]):
    """Several columns to a new one; an argument is a tuple (inputs..., new name)."""
    return lambda _, args: lambda df: df.withColumns({a[-1]: make(*a[:-1]) for a in args})


for _name, _make in {
    "plus_one": scalars.plus_one, "clip_ratio": scalars.clip_ratio, "level": scalars.level,
    "bin_label": scalars.bin_label, "is_value": scalars.is_value, "sign_by_limit": scalars.sign_by_limit,
    "sign_by_text": scalars.sign_by_text, "sex_text": scalars.sex_text,
    "ascii_punctuation": textrules.ascii_punctuation,
}.items():
    OPERATIONS[_name] = _each(_make)
for _name, _make in {
    "plus": scalars.plus, "minus": scalars.minus, "largest": scalars.largest,
    "merge_signs": scalars.merge_signs, "age": dates.age_from_dates,
}.items():
    OPERATIONS[_name] = _derive(_make)


@operation("remain_columns")
def _(_, args):
    return lambda df: columns.remain_columns(df, args)


@operation("keep_complete")
def _(_, args):
    return lambda df: filters.keep_complete(df, args)


@operation("one_hot")
def _(stage_input, args):
    fitted = encode.fit_one_hot(stage_input, args)
    return lambda df: encode.one_hot(df, fitted)


@operation("min_max")
def _(stage_input, args):
    stats = columns.min_max(stage_input, args).first()  # one row
    def scaled(c: str) -> Column:
        low, high = float(stats[f"_min_{c}"]), float(stats[f"_max_{c}"])
        return (F.col(c) - low) / F.lit(high - low + columns.EPS)
    return lambda df: df.withColumns({c: scaled(c) for c in args})


@dataclass(frozen=True)
class FittedFlow:
    steps: tuple[Transform, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def fit_flow(df: DataFrame, stages: Sequence[Stage]) -> FittedFlow:
    """Fit the stages in order. Nothing but the fits runs; stages stay one lazy plan."""
    unknown = {name for stage in stages for name, _ in stage} - set(OPERATIONS)
    if unknown:
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    steps: list[Transform] = []
    for stage in stages:
        made = [OPERATIONS[name](df, args) for name, args in stage]
        for step in made:
            df = step(df)
        steps.extend(made)
    return FittedFlow(tuple(steps))


def run_flow(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    return fit_flow(df, stages).transform(df)


def apply_column(df: DataFrame, col: str, udf, out: str | None = None) -> DataFrame:
    """Hook for user code that no expression covers: a ``pandas_udf`` over one column."""
    return df.withColumn(out or col, udf(F.col(col)))
