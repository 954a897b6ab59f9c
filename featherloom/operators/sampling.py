"""Class balancing and augmentation fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featherloom.functions.hashing import HASH_RANGE, key_hash
from featherloom.operators.ranking import hashed_rank
from featherloom.operators.relations import null_safe


def oversample(df: DataFrame, positive: Column, extra: int, out: str = "copy") -> DataFrame:
    """``extra`` more copies of the positive rows, in one pass (no union chain)."""
    copies = F.when(positive, F.lit(1 + extra)).otherwise(F.lit(1))
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), copies)))


def undersample(df: DataFrame, target: Column, key: str, ratio: float, seed: str = "under") -> DataFrame:
    """Keep the share ``ratio`` of the target class, chosen by hash; all other rows stay."""
    keep = key_hash(F.lit(seed), F.col(key)) < F.lit(int(HASH_RANGE * ratio))
    return df.where(~target | keep)


def fan_out(df: DataFrame, n: int, out: str = "variant") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def quota_fill(df: DataFrame, group: list[str], label: str, wanted: Column, key: str, pct: float,
               variants: int = 1, seed: str = "quota") -> DataFrame:
    """Fill each group with ``unknown`` and ``silence`` rows, ``ceil(size * pct / 100)`` of each.

    Returns (group..., key, label, variant): wanted rows with variant -1 (part of every variant),
    unknown rows in disjoint slices by hash order, and silence rows numbered per group. Ranks come
    from hash slices, so a group of any size is spread over many tasks.
    """
    base = df.where(wanted)
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).withColumn(
        "_quota", F.ceil(F.col("_size") * pct / 100).cast("long"))
    ranked = lambda rows: null_safe(hashed_rank(
        rows.withColumn("_h", key_hash(F.lit(seed), F.col(key))), group, "_h", [key],
        hash_range=HASH_RANGE, rank_name="_rank"), sizes, group)
    unknown = ranked(df.where(~wanted)).withColumn(
        "variant", F.floor(F.col("_rank") / F.col("_quota")).cast("long")).where(F.col("variant") < variants)
    silence = ranked(base).where(F.col("_rank") < F.col("_quota"))
    return (
        base.select(*group, F.col(key), F.col(label), F.lit(-1).cast("long").alias("variant"))
        .unionByName(unknown.select(*group, F.col(key), F.lit("unknown").alias(label), "variant"))
        .unionByName(silence.select(*group, F.col("_rank").cast("long").alias(key), F.lit("silence").alias(label),
                                    F.lit(-1).cast("long").alias("variant")))
    )


def split_words(words: DataFrame, word: str, valid_share: float, split: str = "split", seed: str = "words") -> DataFrame:
    """(word, split): every distinct word goes to ``train`` or ``valid`` by the hash of the word itself, so that no word is in both."""
    part = F.when(key_hash(F.lit(seed), F.col(word)) < F.lit(int(HASH_RANGE * valid_share)), "valid").otherwise("train")
    return words.where(F.col(word).isNotNull()).select(word).distinct().withColumn(split, part)


def unknown_by_split(df: DataFrame, split: str, word: str, wanted: Column, key: str, pct: float, valid_share: float = 0.2,
                     seed: str = "unknown") -> DataFrame:
    """(split, word, key): for each split ``ceil(size * pct / 100)`` rows of unwanted words, whose words are disjoint between splits.

    ``split`` is the part of the wanted rows; unwanted rows take the part of their word. Rows are drawn by hash order.
    """
    sizes = df.where(wanted).groupBy(split).agg(F.ceil(F.count(F.lit(1)) * pct / 100).cast("long").alias("_quota"))
    parts = split_words(df.where(~wanted), word, valid_share, split="_part")
    unknown = df.where(~wanted).join(parts, word).select(F.col("_part").alias(split), word, key)
    ranked = hashed_rank(unknown.withColumn("_h", key_hash(F.lit(seed), F.col(key))), [split], "_h", [key], hash_range=HASH_RANGE, rank_name="_rank")
    return null_safe(ranked, sizes, [split]).where(F.col("_rank") < F.col("_quota")).select(split, word, key)


def symmetric_pairs(df: DataFrame, left: str, right: str, out: str = "swapped") -> DataFrame:
    """Each pair in both orders, in one pass."""
    both = F.array(F.struct(F.col(left).alias("a"), F.col(right).alias("b"), F.lit(0).alias("s")),
                   F.struct(F.col(right).alias("a"), F.col(left).alias("b"), F.lit(1).alias("s")))
    rest = [c for c in df.columns if c not in (left, right)]
    return df.select(*rest, F.explode(both).alias("_p")).select(
        *rest, F.col("_p.a").alias(left), F.col("_p.b").alias(right), F.col("_p.s").alias(out))
