"""Statistics-bearing encoders: fit returns small parameters or a table, transform is one projection
or one join. Fits over many columns share one pass (unpivot, then count)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.functions.hashing import HASH_RANGE, key_hash
from featherloom.operators.columns import with_row
from featherloom.operators.ranking import exact_medians, ordered_prefix
from featherloom.session import durable

# fixed values: a column is one-hot encoded if 1 < distinct values < 100
MIN_CATEGORIES, MAX_CATEGORIES = 1, 100
NAN_TEXT = "nan"


# -- column statistics -------------------------------------------------------------------------

def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (name, mean, median, skew); nulls skipped, skew in the bias-corrected form."""
    def skew(c: str) -> Column:
        n = F.count(c).cast("double")
        return F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))

    row = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *[skew(c).alias(f"skew_{c}") for c in cols])
    both = row.crossJoin(F.broadcast(exact_medians(df, cols)))  # one row each
    return both.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"mean_{c}").alias("mean"),
                 F.col(f"median_{c}").alias("median"), F.col(f"skew_{c}").alias("skew")) for c in cols])))


def above_center_flags(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Flags ``x > median`` and ``x > mean`` per column; null counts as not above."""
    base = fit_on if fit_on is not None else df
    row = exact_medians(base, cols, "_med_").crossJoin(
        F.broadcast(base.agg(*[F.avg(c).alias(f"_avg_{c}") for c in cols])))
    above = lambda c, s: F.coalesce(F.col(c) > F.col(f"{s}{c}"), F.lit(False)).cast("int")
    return with_row(df, row).select(
        *df.columns,
        *[above(c, "_med_").alias(f"{c}_median_range") for c in cols],
        *[above(c, "_avg_").alias(f"{c}_mean_range") for c in cols])


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value, n) for every listed column in one shuffle; null reads ``nan``."""
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NAN_TEXT)).alias(c) for c in cols])
    return texts.unpivot([], list(cols), "name", "value").groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n"))


def bounded_value_counts(df: DataFrame, cols: Sequence[str], low: int = MIN_CATEGORIES,
                         high: int = MAX_CATEGORIES) -> DataFrame:
    """Value counts of the columns with ``low < distinct < high``."""
    counts = value_counts(df, cols)
    kept = counts.groupBy("name").agg(F.count(F.lit(1)).alias("d")).where(
        (F.col("d") > low) & (F.col("d") < high)).select("name")
    return counts.join(F.broadcast(kept), "name", "left_semi")  # at most one row per column


def distinct_counts(df: DataFrame, cols: Sequence[str], source: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and source, long form."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.groupBy(source).agg(*[count(c).alias(c) for c in cols])
    return wide.unpivot([source], list(cols), "name", "distinct_values")


# -- one-hot -----------------------------------------------------------------------------------

def fit_one_hot(df: DataFrame, cols: Sequence[str], low: int = MIN_CATEGORIES,
                high: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted categories of the columns in range: at most ``high`` values per column."""
    out: dict[str, list[str]] = {}
    for row in bounded_value_counts(df, cols, low, high).collect():  # < high rows per column
        out.setdefault(row["name"], []).append(row["value"])
    return {c: sorted(out[c]) for c in cols if c in out}


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]], joiner: str = "_",
            keep: bool = False) -> DataFrame:
    """A 0/1 float column per category, named ``column_value``; the source column is dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NAN_TEXT))
    rest = [c for c in df.columns if keep or c not in categories]
    return df.select(*rest, *[
        (text(c) == F.lit(v)).cast("float").alias(f"{c}{joiner}{v}") for c in categories for v in categories[c]])


def frequent_values(train: DataFrame, test: DataFrame, cols: Sequence[str], min_ones: int = 50) -> DataFrame:
    """(name, value, n): values with at least ``min_ones`` rows in train and test together; a null is no value.

    Long form, for any number of values: join it to an unpivoted row for sparse indicator columns.
    """
    both = train.select(*cols).unionByName(test.select(*cols))
    long = both.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "name", "value").where("value is not null")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_ones)


def fit_frequent_one_hot(train: DataFrame, test: DataFrame, cols: Sequence[str], min_ones: int = 50) -> dict[str, list[str]]:
    """The values of ``frequent_values`` by column, for columns of few values: each becomes a column of the result."""
    out: dict[str, list[str]] = {}
    for row in frequent_values(train, test, cols, min_ones).select("name", "value").collect():
        out.setdefault(row["name"], []).append(row["value"])
    return {c: sorted(out.get(c, [])) for c in cols}


def fit_one_hot_by_unique(df: DataFrame, cols: Sequence[str], low: int = 3, high: int = 6) -> dict[str, list[str]]:
    """Columns with low..high distinct values (null counted as one); the null has no dummy."""
    fitted = fit_one_hot(df, cols, low - 1, high + 1)
    return {c: [v for v in vs if v != NAN_TEXT] for c, vs in fitted.items()}


# -- dense codes -------------------------------------------------------------------------------

def sorted_codes(df: DataFrame, col: str, start: int = 0) -> DataFrame:
    """(value, code): distinct non-null values numbered in sorted order."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    return ordered_prefix(values, [], [F.col(col)], row_number="_rn").select(
        col, (F.col("_rn") - 1 + start).cast("long").alias("code"))


def frequency_codes(df: DataFrame, col: str, start: int = 1, n: str | None = None) -> DataFrame:
    """(value, n, code): values numbered by falling count, then by value. Where rows stand for several, ``n`` names their number."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))
    return ordered_prefix(counts, [], [F.col("n").desc(), F.col(col)], row_number="_rn").select(
        col, "n", (F.col("_rn") - 1 + start).cast("long").alias("code"))


def first_seen_codes(df: DataFrame, col: str, order: str, start: int = 0) -> DataFrame:
    """(value, code): values numbered by the smallest order key they occur with."""
    seen = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_at"))
    return ordered_prefix(seen, [], [F.col("_at"), F.col(col)], row_number="_rn").select(
        col, (F.col("_rn") - 1 + start).cast("long").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, col: str, out: str, unseen: int | None = None) -> DataFrame:
    """Attach codes; values without one get ``unseen``."""
    table = codes.select(col, F.col("code").alias(out))
    joined = df.join(table, col, "left")
    return joined if unseen is None else joined.withColumn(out, F.coalesce(out, F.lit(unseen)))


def sparse_rows(df: DataFrame, key: str, label: str, fields: Sequence[str]) -> DataFrame:
    """One text line ``label field:code:1 ...`` per row, with one code dictionary over all fields."""
    long = df.select(key, label, F.posexplode(F.array(*[F.col(f).cast("string") for f in fields]))
                     .alias("field", "value")).where("value is not null")
    distinct = long.select("field", "value").distinct()
    codes = ordered_prefix(distinct, [], [F.col("field"), F.col("value")], row_number="_rn").select(
        "field", "value", (F.col("_rn") - 1).alias("code"))
    item = F.concat_ws(":", F.col("field").cast("string"), F.col("code").cast("string"), F.lit("1"))
    return (
        long.join(codes, ["field", "value"])
        .groupBy(key, label)  # as many items as there are fields
        .agg(F.array_sort(F.collect_list(F.struct("field", item.alias("item")))).alias("xs"))
        .select(key, F.concat_ws(" ", F.col(label).cast("string"),
                                 F.array_join(F.transform("xs", lambda x: x["item"]), " ")).alias("line"))
    )


# -- target encoding ---------------------------------------------------------------------------

def _smoothed(n: Column, total: Column, prior: Column, min_leaf: float, smoothing: float) -> Column:
    weight = 1 / (1 + F.exp(-(n - F.lit(float(min_leaf))) / F.lit(float(smoothing))))
    return F.when(n > 0, prior * (1 - weight) + total / n * weight).otherwise(prior)


def fit_target_table(train: DataFrame, col: str, target: str, min_leaf: float, smoothing: float) -> DataFrame:
    """(value, enc) and the prior, fitted on all of train."""
    prior = train.agg(F.avg(target).alias("prior"))
    sums = train.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(target).cast("double")).alias("s"))
    return with_row(sums, prior).select(
        col, _smoothed(F.col("n"), F.col("s"), F.col("prior"), min_leaf, smoothing).alias("enc"))


def lookup_or_prior(df: DataFrame, table: DataFrame, col: str, prior: DataFrame, out: str) -> DataFrame:
    """Left join to group statistics; an unseen or null key gets the prior (a one-row frame)."""
    joined = df.join(table.select(col, F.col("enc").alias("_enc")), col, "left")
    return with_row(joined, prior).select(*df.columns, F.coalesce("_enc", "prior").alias(out))


def oof_target_encode(df: DataFrame, col: str, target: str, fold: str, *, min_leaf: float = 200,
                      smoothing: float = 10, out: str | None = None, noise: float = 0.0,
                      noise_key: str | None = None) -> DataFrame:
    """Each row is encoded with statistics of the other folds only.

    One aggregate by (value, fold) serves all folds: the total of a value minus its own fold. It is
    written once, so the rows are read twice in all; the join is left to the adaptive planner, which
    knows the table's bytes. Values with a null or seen in no other fold get the prior of the other
    folds.
    """
    out = out or f"{col}_enc"
    y = F.col(target).cast("double")
    cells = durable(df.groupBy(col, fold).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s")))
    # the window runs over aggregated cells: one row per fold of a value
    by_value = Window.partitionBy(col)
    per_fold = cells.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    everything = per_fold.agg(F.sum("fn").alias("an"), F.sum("fs").alias("as"))
    priors = with_row(per_fold, everything).select(
        fold, ((F.col("as") - F.col("fs")) / F.nullif(F.col("an") - F.col("fn"), F.lit(0.0))).alias("prior"))
    others = cells.select(
        col, fold, (F.sum("n").over(by_value) - F.col("n")).alias("n"),
        (F.sum("s").over(by_value) - F.col("s")).alias("s"))
    table = others.join(F.broadcast(priors), fold).select(  # one prior per fold
        F.col(col).alias("_v"), F.col(fold).alias("_f"),
        F.when(F.col(col).isNull(), F.col("prior")).otherwise(
            _smoothed(F.col("n"), F.col("s"), F.col("prior"), min_leaf, smoothing)).alias(out))
    joined = df.join(table, F.col(col).eqNullSafe(F.col("_v")) & (F.col(fold) == F.col("_f"))).drop("_v", "_f")
    if noise:
        if noise_key is None:
            raise ValueError("noise needs a key column to stay deterministic")
        u = lambda seed: (key_hash(F.col(noise_key), F.lit(seed)) + 1) / F.lit(float(HASH_RANGE + 1))
        normal = F.sqrt(-2 * F.ln(u("a"))) * F.cos(F.lit(2 * math.pi) * u("b"))
        joined = joined.withColumn(out, F.col(out) * (1 + F.lit(noise) * normal))
    return joined


def fold_mean_encode(train: DataFrame, test: DataFrame, col: str, target: str, fold: str, *, min_leaf: float = 200, smoothing: float = 10,
                     out: str | None = None) -> DataFrame:
    """The test rows under the mean of the fold tables of ``oof_target_encode``; unseen and null values get the mean prior.

    A value meets every fold once (folds are few), so the grid is as long as the distinct values times the folds.
    """
    out = out or f"{col}_enc"
    cells = durable(train.groupBy(col, fold).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(target).cast("double")).alias("s")))
    per_fold = cells.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    priors = with_row(per_fold, per_fold.agg(F.sum("fn").alias("an"), F.sum("fs").alias("as"))).select(
        F.col(fold).alias("_f"), ((F.col("as") - F.col("fs")) / F.nullif(F.col("an") - F.col("fn"), F.lit(0.0))).alias("prior"))
    listed = cells.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct("n", "s")))).alias("_own"))
    own = lambda x: F.coalesce(F.try_element_at("_own", F.col("_f"))[x], F.lit(0.0))
    grid = listed.crossJoin(F.broadcast(priors))    # a row for each fold
    table = grid.groupBy(col).agg(F.avg(_smoothed(F.col("_n") - own("n"), F.col("_s") - own("s"), F.col("prior"), min_leaf, smoothing)).alias("_enc"))
    joined = test.join(table, col, "left")
    return with_row(joined, priors.agg(F.avg("prior").alias("_prior"))).withColumn(out, F.coalesce("_enc", "_prior")).select(*test.columns, out)


# -- imputation --------------------------------------------------------------------------------

def most_frequent(df: DataFrame, cols: Sequence[str], prefix: str = "mode_") -> DataFrame:
    """One row with the most frequent value of each column; ties go to the smallest value."""
    counts = df.select(*cols).unpivot([], list(cols), "name", "value").where("value is not null") \
        .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b"))
    return best.groupBy().agg(*[
        F.max(F.when(F.col("name") == c, F.col("b.value"))).alias(f"{prefix}{c}") for c in cols])


def impute(df: DataFrame, modes: Sequence[str] = (), medians: Sequence[str] = (), means: Sequence[str] = (),
           fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls by mode, median or mean, fitted on ``fit_on`` (default: the frame itself)."""
    base = fit_on if fit_on is not None else df
    filled, out = df, list(df.columns)
    if modes:
        filled = with_row(filled, most_frequent(base, modes, "_fill_"))
    if medians:
        filled = with_row(filled, exact_medians(base, medians, "_fill_"))
    if means:
        filled = with_row(filled, base.agg(*[F.avg(c).alias(f"_fill_{c}") for c in means]))
    touched = {*modes, *medians, *means}
    types = dict(df.dtypes)
    fill = lambda c: F.coalesce(F.col(c), F.col(f"_fill_{c}").cast(types[c] if c in modes else "double"))
    return filled.select(*[fill(c).alias(c) if c in touched else F.col(c) for c in out])
