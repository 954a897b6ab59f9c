"""Combining the predictions of several models. All inputs are long: one row per (model, id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featherloom.operators.evaluate import model_pairs
from featherloom.operators.ranking import ordered_prefix, slices_by_rows
from featherloom.operators.relations import null_safe


def rank_average(df: DataFrame, model: str, key: str, score: str) -> DataFrame:
    """Mean over models of ``(rank - 1) / (n - 1)``; equal scores are ordered by key."""
    rows = df.select(model, key, score)
    ranked = ordered_prefix(rows, [model], [F.col(score), F.col(key)], size="n", slices=slices_by_rows(rows))
    return ranked.groupBy(key).agg(
        F.avg((F.col("row_num") - 1) / F.nullif(F.col("n") - 1, F.lit(0))).alias("score"))


def tied_rank(df: DataFrame, model: str, score: str, out: str = "rank") -> DataFrame:
    """Average rank of equal scores divided by n, per model, from counts of distinct scores."""
    counted = df.groupBy(model, score).agg(F.count(F.lit(1)).alias("c"))
    ranked = ordered_prefix(counted, [model], [F.col(score)], row_number=None, sums={"upto": "c"})
    table = ranked.select(model, score, ((F.col("upto") - (F.col("c") - 1) / 2) / F.col("upto_total")).alias(out))
    return null_safe(df, table, [model, score])


def mean_by_key(df: DataFrame, keys: Sequence[str], score: str, out: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(out))


def weight_of(model: str, weights: Mapping[str, float], normalise: bool = False) -> Column:
    """The weight of a row's model as a literal lookup; models without a weight count 0."""
    total = sum(weights.values()) if normalise else 1.0
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(F.col(model) == name, F.lit(w / total)).otherwise(out)
    return out


def weighted_mean(df: DataFrame, model: str, keys: Sequence[str], score: str,
                  weights: Mapping[str, float]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(weight_of(model, weights) * F.col(score)).alias("score"))


def geometric_mean(df: DataFrame, model: str, keys: Sequence[str], score: str,
                   weights: Mapping[str, float], eps: float = 1e-15) -> DataFrame:
    """``exp(sum w ln p)`` with the weights normalised to 1."""
    p = F.greatest(F.col(score), F.lit(eps))
    return df.groupBy(*keys).agg(
        F.exp(F.sum(weight_of(model, weights, True) * F.ln(p))).alias("score"))


def logit_mean(df: DataFrame, keys: Sequence[str], score: str, eps: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*keys).agg((1 / (1 + F.exp(-F.avg(F.ln(p / (1 - p)))))).alias("score"))


def majority_vote(df: DataFrame, model: str, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per key. A tie goes to the label of the earliest model, then by label."""
    keys = list(keys)
    votes = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("votes"), F.min(model).alias("first"))
    best = F.min(F.struct((-F.col("votes")).alias("neg"), "first", F.col(label).alias("label")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.label").alias("label"), (-F.col("b.neg")).alias("votes"))


def two_level_vote(df: DataFrame, model: str, variant: str, keys: Sequence[str], label: str) -> DataFrame:
    """Vote over the variants of each model, then over the models."""
    inner = majority_vote(df, variant, [*keys, model], label).drop("votes")
    return majority_vote(inner, model, keys, "label")


def rule_vote(df: DataFrame, model: str, keys: Sequence[str], label: str) -> DataFrame:
    """Two or more ``unknown`` give ``silence`` if any model said so, else ``unknown``; otherwise
    the majority decides."""
    keys = list(keys)
    votes = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"), F.min(model).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "first", F.col(label).alias("label")))
    said = lambda what: F.coalesce(F.max(F.when(F.col(label) == what, F.col("n"))), F.lit(0))
    final = F.when((F.col("unknown") >= 2) & (F.col("silence") > 0), "silence") \
        .when(F.col("unknown") >= 2, "unknown").otherwise(F.col("b.label"))
    return votes.groupBy(*keys).agg(
        best.alias("b"), said("unknown").alias("unknown"), said("silence").alias("silence"),
    ).select(*keys, final.alias("label"))


def vote_signature(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per key: ``label+count`` pairs by falling count joined with ``_``, whether the top two both
    have two votes, and how many voters said ``unknown``. A key holds at most one item per label."""
    keys = list(keys)
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label")))).alias("xs"),
        F.coalesce(F.max(F.when(F.col(label) == "unknown", F.col("n"))), F.lit(0).cast("long")).alias("unknown"))
    top = lambda i: F.get("xs", F.lit(i))["neg"] == -2
    return packed.select(
        *keys,
        F.array_join(F.transform("xs", lambda x: F.concat(x["label"], (-x["neg"]).cast("string"))), "_").alias("signature"),
        F.coalesce(top(0) & top(1), F.lit(False)).alias("tied"), "unknown")


def agreement(df: DataFrame, model: str, key: str, label: str) -> DataFrame:
    """Share and number of ids on which two models agree, for every pair of models."""
    same = (F.col("value_a") == F.col("value_b"))
    return model_pairs(df, [key], model, label).groupBy("model_a", "model_b").agg(
        F.avg(same.cast("double")).alias("rate"), F.count_if(same).alias("same"))


def least_similar(df: DataFrame, model: str, key: str, label: str, k: int) -> DataFrame:
    """The k models with the lowest total agreement with the others (a top-k report)."""
    pairs = agreement(df, model, key, label)
    both = pairs.select(F.explode(F.array("model_a", "model_b")).alias("model"), "same")
    return both.groupBy("model").agg(F.sum("same").alias("total")).orderBy("total", "model").limit(k)


def argmax_long(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Label with the highest probability per key; ties go to the smallest label."""
    return df.groupBy(*keys).agg(
        F.min(F.struct((-F.col(prob)).alias("neg"), F.col(label).alias("label"))).alias("b")
    ).select(*keys, F.col("b.label").alias("label"), (-F.col("b.neg")).alias("prob"))
