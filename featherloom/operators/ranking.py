"""Global order without a one-partition window.

A plain window over ``partitionBy(group)`` puts a whole group in one task, which fails when one
group holds a large share of the rows. Two forms are offered here:

* ``ordered_prefix`` range-partitions by (group, order), so a hot group is spread over many slices,
  ranks inside each slice and adds the totals of the slices before it;
* ``hashed_rank`` does the same for an order given by a uniform hash, where the slice is simply the
  leading part of the hash and no range sampling or checkpoint is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.operators.relations import null_safe
from featherloom.session import durable, slices_of, stored

SLICE, PLACE = "_slice", "_place"


def ordered_prefix(df: DataFrame, group: Sequence[str], order: Sequence[Column], *,
                   row_number: str | None = "row_num",
                   sums: Mapping[str, str | Column] | None = None,
                   size: str | None = None, slices: int | None = None) -> DataFrame:
    """Add a row number and inclusive running sums over ``order`` within ``group``.

    ``size`` names a column for the number of rows of the group; every sum ``x`` also gets its group
    total as ``x_total``. Both come from the slice totals, without another pass.
    ``order`` should be total (end with a unique key) when ``row_number`` is wanted. A null group is
    a group of its own. The slice id is only stable once written, so the sliced rows are checkpointed,
    each with its place in the sorted slice: row numbers need no second shuffle, and a task of the
    running sums holds one slice.
    """
    sums = dict(sums or {})
    group = list(group)
    slices = slices or slices_of(df)
    for name, source in sums.items():
        df = df.withColumn(f"_in_{name}", F.col(source) if isinstance(source, str) else source)
    keys = [*[F.col(c) for c in group], *order]
    laid = durable(
        df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
        .withColumn(PLACE, F.monotonically_increasing_id())     # the slice, and 33 bits for the place inside it
        .withColumn(SLICE, F.shiftright(PLACE, 33).cast("int"))
    )
    totals = laid.groupBy(*group, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first"),
        *[F.sum(f"_in_{name}").alias(f"_tot_{name}") for name in sums],
    )
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)  # one row per slice
    offsets = stored(totals.select(     # its size is known, so that a small one is broadcast and the rows stay where they are
        *group, SLICE, "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off_rows"),
        *([F.sum("_rows").over(whole).alias(size)] if size else []),
        *[F.sum(f"_tot_{name}").over(whole).alias(f"{name}_total") for name in sums],
        *[F.coalesce(F.sum(f"_tot_{name}").over(before), F.lit(0)).alias(f"_off_{name}")
          for name in sums],
    ), "offsets")
    running = Window.partitionBy(*group, SLICE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = null_safe(laid.repartitionById(max(laid.rdd.getNumPartitions(), 1), F.col(SLICE)) if sums else laid, offsets, [*group, SLICE])
    if row_number:
        out = out.withColumn(row_number, F.col(PLACE) - F.col("_first") + 1 + F.col("_off_rows"))
    for name in sums:
        out = out.withColumn(name, F.sum(f"_in_{name}").over(running) + F.col(f"_off_{name}"))
    return out.drop(SLICE, PLACE, "_first", "_off_rows", *[f"_in_{n}" for n in sums], *[f"_off_{n}" for n in sums])


SLICE_ROWS = 1 << 20


def slices_by_rows(df: DataFrame) -> int:
    """Slices of a bounded number of rows, for rows that are cheap to count: what a scan is estimated at says little once rows are exploded."""
    return max(slices_of(df), -(-df.count() // SLICE_ROWS))


def hashed_rank(df: DataFrame, group: Sequence[str], hash_col: str, tie: Sequence[str], *,
                hash_range: int, rank_name: str = "rank", slices: int | None = None) -> DataFrame:
    """Row number (from 0) within ``group`` in the order of a uniform hash in [0, hash_range).

    A null group is a group of its own.
    """
    group = list(group)
    slices = slices or 4 * slices_of(df)
    sliced = df.withColumn(
        SLICE, F.floor(F.col(hash_col).cast("double") * slices / hash_range).cast("int"))
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*group, SLICE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*group, SLICE).orderBy(hash_col, *tie)
    return (
        null_safe(sliced, offsets, [*group, SLICE])
        .withColumn(rank_name, F.row_number().over(inside) - 1 + F.col("_off"))
        .drop(SLICE, "_off")
    )


BRACKET, ACCURACY = 0.001, 10_000     # the sketch's rank error, 1 / ACCURACY, is well inside the bracket


def exact_medians(df: DataFrame, cols: Sequence[str], prefix: str = "median_") -> DataFrame:
    """One row of exact medians (nulls skipped; the mean of the middle two on even counts).

    One pass sketches two values around each median; a second one counts what lies below them and keeps only what lies between,
    where the exact rank is found. So some thousandths of the values are shuffled and ordered, not whole columns.
    """
    cols = list(cols)
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    around = base.agg(*[F.percentile_approx(c, [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias(f"_around_{c}") for c in cols])
    cell = lambda c: F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.get(f"_around_{c}", F.lit(0)).alias("lo"), F.get(f"_around_{c}", F.lit(1)).alias("hi"))
    long = (base.crossJoin(F.broadcast(around))     # one row
            .select(F.inline(F.array(*[cell(c) for c in cols]))).where("value is not null"))
    sizes = long.groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("value") < F.col("lo")).alias("below"))
    counted = long.where(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = ordered_prefix(counted, ["name"], [F.col("value")], row_number=None, sums={"upto": "n"}).join(sizes, "name")
    last = F.col("below") + F.col("upto")
    covers = lambda pos: (last - F.col("n") < pos) & (pos <= last)
    middle = ordered.where(covers(F.floor((F.col("all") + 1) / 2)) | covers(F.floor((F.col("all") + 2) / 2))) \
        .groupBy("name").agg(F.avg("value").alias("median"))
    return middle.groupBy().agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{prefix}{c}") for c in cols])
