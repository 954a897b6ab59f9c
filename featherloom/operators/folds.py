"""Deterministic fold and split assignment, membership, and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featherloom.functions.hashing import HASH_RANGE, hash_percent, key_hash
from featherloom.operators.ranking import hashed_rank


def shuffled_fold(key: str, k: int, seed: str = "0") -> Column:
    """Fold 0..k-1 by hash of the key: a projection, no shuffle."""
    return F.pmod(key_hash(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: str = "0") -> DataFrame:
    """Folds whose label shares differ by at most one row: rank by hash within the label, modulo k."""
    hashed = df.withColumn("_h", key_hash(F.lit(seed), F.col(key)))
    ranked = hashed_rank(hashed, [label], "_h", [key], hash_range=HASH_RANGE, rank_name="_rank")
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_h", "_rank")


def group_of(name: Column | str, marker: str = "_nohash_") -> Column:
    """The contributor part of a file name: everything before the marker."""
    name = F.col(name) if isinstance(name, str) else name
    return F.substring_index(name, marker, 1)


def grouped_fold(group: Column | str, k: int) -> Column:
    """All rows of a group in one fold by the hash percentage of the group name; a hash of exactly
    100 percent is in no fold (-1) and only ever trains."""
    share = hash_percent(group)
    return F.when(share >= 100.0, F.lit(-1)).otherwise(F.floor(share * k / 100.0)).cast("int")


def percent_split(group: Column | str, valid: float, test: float) -> Column:
    share = hash_percent(group)
    return F.when(share < valid, "valid").when(share < valid + test, "test").otherwise("train")


def fold_members(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per fold round, as ``valid`` where it belongs and as ``train`` elsewhere."""
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rounds.withColumn("role", F.when(F.col(fold) == F.col("round"), "valid").otherwise("train"))


def label_shares(df: DataFrame, by: Sequence[str], labels: Sequence[str], places: int = 5) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"),
                               *[F.round(F.avg(c), places).alias(c) for c in labels])


def leaking_keys(df: DataFrame, key: str, fold: str) -> DataFrame:
    """Keys found in more than one fold. One aggregate, no self join."""
    return df.groupBy(key).agg(F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold")).where(
        F.col("first_fold") != F.col("last_fold"))


def matched_predictions(preds: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Inner 1:1 match of all folds' predictions to the truth; a missing or repeated id is an error."""
    joined = truth.join(preds.groupBy(key).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("_n")), key, "left")
    bad = joined.agg(F.count_if(F.col("_n").isNull() | (F.col("_n") != 1)).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"{bad} ids have no prediction or more than one")
    return joined.drop("_n")


def hash_prefix(df: DataFrame, key: str, share: float, seed: str = "shuffle") -> DataFrame:
    """Train for the first ``share`` of the seeded hash range, test for the rest; no sort."""
    part = F.when(key_hash(F.lit(seed), F.col(key)) < F.lit(int(HASH_RANGE * share)), "train").otherwise("test")
    return df.withColumn("part", part)


def shuffled_order(df: DataFrame, key: str, seed: str = "shuffle") -> DataFrame:
    """Rows with their position in a seeded shuffle."""
    hashed = df.withColumn("_h", key_hash(F.lit(seed), F.col(key)))
    return hashed_rank(hashed, [], "_h", [key], hash_range=HASH_RANGE, rank_name="position").drop("_h")
