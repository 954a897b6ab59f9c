"""Frame-level column operators. Statistics are one aggregate row, broadcast back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
import warnings

from pyspark.sql import Column, DataFrame, functions as F, types as T

EPS = 1e-7   # fixed value: keeps a constant column from dividing by zero


def _known(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


def remain_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    _known(df, cols)
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    _known(df, cols)
    extra = [c for c in df.columns if prefix and c.startswith(prefix)]
    return df.drop(*cols, *extra)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row frame of statistics to every row (one row: always safe to broadcast)."""
    return df.crossJoin(F.broadcast(row))


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])


def normalization(df: DataFrame, cols: Sequence[str], val_range: int = 0,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Min-max scale the columns to [-1, 1] (``val_range`` 0) or [0, 1] (1), fitted on ``fit_on``."""
    stats = min_max(fit_on if fit_on is not None else df, cols)

    def scaled(c: str) -> Column:
        share = (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}") + F.lit(EPS))
        return 2 * (share - 0.5) if val_range == 0 else share

    return with_row(df, stats).select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def narrow_types(df: DataFrame) -> DataFrame:
    """doubles to float, and integers to tinyint where the observed values fit (others stay)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    fits: set[str] = set()
    if ints:
        seen = min_max(df, ints).first()
        fits = {c for c in ints if seen[f"_min_{c}"] is not None
                and -128 <= seen[f"_min_{c}"] and seen[f"_max_{c}"] <= 127}
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name).cast("tinyint").alias(f.name) if f.name in fits else F.col(f.name)
        for f in df.schema.fields])


def descartes(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Products of every left column with every right column, named ``a_x_b``."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a in left for b in right})


def descartes_interaction(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Products of all unordered pairs of the columns."""
    if len(cols) < 2:
        warnings.warn("an interaction needs at least two columns; the frame is unchanged")
        return df
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(cols, 2)})


def equal_width_bins(df: DataFrame, cols: Sequence[str], n: int = 50, suffix: str = "_bin") -> DataFrame:
    """Integer bin 0..n-1 of equal width, right-closed; the minimum falls in bin 0."""
    def binned(c: str) -> Column:
        width = (F.col(f"_max_{c}") - F.col(f"_min_{c}")) / n
        return F.when(F.col(c).isNotNull(), F.greatest(F.coalesce(
            F.ceil(F.round((F.col(c) - F.col(f"_min_{c}")) / F.nullif(width, F.lit(0.0)), 9)) - 1, F.lit(0)),
            F.lit(0)).cast("int"))
    return with_row(df, min_max(df, cols)).select(
        *df.columns, *[binned(c).alias(f"{c}{suffix}") for c in cols])


def shared_range(df: DataFrame, cols: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Scale all columns to [-1, 1] by one minimum and maximum taken over all of them."""
    row = df.agg(F.min(F.least(*cols) if len(cols) > 1 else F.col(cols[0])).alias("_lo"),
                 F.max(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).alias("_hi"))
    scaled = lambda c: 2 * ((F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps)) - 0.5)
    return with_row(df, row).select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def missing_feature(df: DataFrame, cols: Sequence[str], name: str = "negative_one_vals") -> DataFrame:
    """Number of nulls per row, min-max scaled to [-1, 1] over the frame."""
    from featherloom.functions.scalars import null_count

    counted = df.withColumn(name, null_count(cols).cast("double"))
    return normalization(counted, [name], 0)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def ordinal_map(df: DataFrame, factor: str, display: str, table: Mapping[tuple[str, str], float],
                out: str = "code") -> DataFrame:
    """Display values to numbers by (factor, display); a factor without entries is read as a number,
    and a display value that a mapped factor does not know is named in ``error``."""
    spark = df.sparkSession
    known = spark.createDataFrame([(f, d, float(v)) for (f, d), v in table.items()],
                                  f"{factor} string, {display} string, _mapped double")
    mapped = F.col(factor).isin(sorted({f for f, _ in table}))
    joined = df.join(F.broadcast(known), [factor, display], "left")  # a literal table, held in code
    return joined.select(
        *df.columns,
        F.when(mapped, F.col("_mapped")).otherwise(F.col(display).try_cast("double")).alias(out),
        F.when(mapped & F.col("_mapped").isNull(), F.col(display)).alias("error"))


def model_inputs(df: DataFrame, key: str, levels: Mapping[str, tuple[int, int]],
                 bounds: Mapping[str, tuple[float, float]], plain: Sequence[str],
                 limits: Mapping[str, tuple[float, float]], features: Sequence[str]) -> DataFrame:
    """One row to scaled model inputs: one-hot of fixed levels, one-hot L/M/H against bounds, plain
    numbers; unknown features read 0; each is divided by its (max - min), or by 1 if that is 0."""
    made: dict[str, Column] = {}
    for c, (low, high) in levels.items():
        for i in range(low, high + 1):
            made[f"{c}_{i}"] = (F.col(c) == i).cast("double")
    for c, (low, high) in bounds.items():
        made[f"{c}_L"] = (F.col(c) < low).cast("double")
        made[f"{c}_H"] = (F.col(c) > high).cast("double")
        made[f"{c}_M"] = F.col(c).between(low, high).cast("double")
    for c in plain:
        made[c] = F.col(c).cast("double")

    def scaled(name: str) -> Column:
        low, high = limits.get(name, (0.0, 1.0))
        return (F.coalesce(made.get(name, F.lit(0.0)), F.lit(0.0)) - low) / F.lit((high - low) or 1.0)

    return df.select(key, *[scaled(f).alias(f) for f in features])


def linear_risk(df: DataFrame, key: str, weights: Mapping[str, float], bias: float) -> DataFrame:
    """Logistic of the weighted sum of the feature columns: a plain row expression, no shuffle."""
    dot = F.lit(float(bias))
    for c, w in weights.items():
        dot = dot + F.lit(float(w)) * F.col(c)
    return df.select(key, (1 / (1 + F.exp(-dot))).alias("risk"))


def weight_report(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Features with their weight and their mean contribution over the rows, by falling |weight|."""
    means = df.agg(*[F.avg(F.lit(float(w)) * F.col(c)).alias(c) for c, w in weights.items()])
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("weight"),
                                F.col(c).alias("contribution")) for c, w in weights.items()])
    return means.select(F.inline(listed)).orderBy(F.abs("weight").desc(), "feature")


def keyed_json(df: DataFrame, key: str, names: str, values: str, renames: Mapping[str, tuple[str, str]],
               out: str = "json", sep: str = ",") -> DataFrame:
    """``names`` and ``values`` are parallel separated lists; rename each through the table into
    nested JSON, keys sorted. Rows whose lists differ in length give null."""
    pairs = F.map_from_arrays(F.split(names, sep), F.split(values, sep))
    ok = F.size(F.split(names, sep)) == F.size(F.split(values, sep))
    groups: dict[str, dict[str, str]] = {}
    for flat, (name, part) in renames.items():
        groups.setdefault(name, {})[part] = flat
    body = F.struct(*[
        F.struct(*[F.col("_kv").getItem(groups[n][p]).alias(p) for p in sorted(groups[n])]).alias(n)
        for n in sorted(groups)])
    return df.withColumn("_kv", F.when(ok, pairs)).select(
        key, F.when(F.col("_kv").isNotNull(), F.to_json(body)).alias(out))
