"""Scores of predictions against truth: Gini, AUC, accuracy, confusion, F1 threshold, losses.

Predictions are long tables; the grouping columns (model, label name, ...) are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.evaluation import Evaluator

from featherloom.operators.ranking import ordered_prefix, slices_by_rows


def normalized_gini(df: DataFrame, group: Sequence[str], truth: str, score: str, key: str,
                    out: str = "gini") -> DataFrame:
    """Normalised Gini per group; equal scores are ordered by ``key`` ascending.

    The cumulative sum of truths collapses to a weighted sum of ranks, so only ranks are needed.
    """
    group = list(group)
    rows = df.select(*group, F.col(truth).cast("double").alias("a"), F.col(score).alias("s"),
                     F.col(key).alias("k"))
    ranked = ordered_prefix(rows, group, [F.col("s").desc(), F.col("k")], slices=slices_by_rows(rows))
    actual = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a_sum"),
        F.sum(F.col("a") * F.col("row_num")).alias("ar"))
    blocks = ordered_prefix(
        rows.groupBy(*group, "a").agg(F.count(F.lit(1)).alias("c")), group, [F.col("a").desc()],
        row_number=None, sums={"upto": "c"})
    rank_sum = F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2
    best = blocks.groupBy(*group).agg(F.sum(F.col("a") * rank_sum).alias("ar_best"))
    joined = actual.join(best, group) if group else actual.crossJoin(F.broadcast(best))
    # sum(cumsum(a)) = sum(a * (n - r + 1)); both ratios share the factor 1/n, which cancels.
    area = lambda ar: (F.col("n") + 1) - F.col(ar) / F.nullif(F.col("a_sum"), F.lit(0.0)) \
        - (F.col("n") + 1) / 2
    return joined.select(*group, (area("ar") / F.nullif(area("ar_best"), F.lit(0.0))).alias(out))


def roc_auc(df: DataFrame, group: Sequence[str], truth: str, score: str,
            out: str = "auc") -> DataFrame:
    """ROC AUC per group from average ranks; null when a group has only one class."""
    group = list(group)
    counted = df.groupBy(*group, F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col(truth).cast("long")).alias("pos"))
    ranked = ordered_prefix(counted, group, [F.col("s")], row_number=None, sums={"upto": "c"})
    mean_rank = F.col("upto") - (F.col("c") - 1) / 2
    agg = ranked.groupBy(*group).agg(
        F.sum("c").alias("n"), F.sum("pos").alias("p"),
        F.sum(F.col("pos") * mean_rank).alias("rank_sum"))
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    return agg.select(
        *group,
        ((F.col("rank_sum") - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0.0))).alias(out))


def macro_mean(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias(out))


def accuracy(df: DataFrame, group: Sequence[str], truth: str, pred: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, group: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Counts by (truth, pred) in long form; errors are the rows with ``truth <> pred``."""
    return df.groupBy(*group, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per truth, one count column per class of a fixed list."""
    return df.groupBy(F.col(truth).alias("truth")).agg(
        *[F.count_if(F.col(pred) == F.lit(c)).alias(f"pred_{c}") for c in classes])


def bad_cases(df: DataFrame, truth: str, score: str) -> DataFrame:
    """False negatives (truth 1, score < 0.5) and false positives (truth 0, score > 0.5)."""
    kind = F.when((F.col(truth) == 1) & (F.col(score) < 0.5), "fn") \
        .when((F.col(truth) == 0) & (F.col(score) > 0.5), "fp")
    return df.withColumn("kind", kind).where("kind is not null")


def best_f1(df: DataFrame, group: Sequence[str], truth: str, score: str, steps: int = 100) -> DataFrame:
    """Threshold i/steps, i = 0 .. steps-1, with the highest F1 for ``score > threshold``.

    Each row meets only one bin of a histogram; the suffix sums run over at most steps+1 bins.
    """
    group = list(group)
    bins = (
        # score > i/steps holds for the first ``above`` thresholds
        df.withColumn("above", F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil(
            F.round(F.col(score) * steps, 9)))).cast("int"))
        .groupBy(*group, "above")
        .agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(truth).cast("long")).alias("pos"))
    )
    spread = bins.groupBy(*group).agg(
        F.collect_list(F.struct("above", "c", "pos")).alias("h"), F.sum("pos").alias("total"))
    stepped = spread.select(*group, "h", "total", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    tail = lambda f: F.aggregate(
        F.filter("h", lambda b: b["above"] > F.col("i")), F.lit(0).cast("long"),
        lambda acc, b: acc + b[f])
    scored = stepped.select(*group, "i", "total", tail("c").alias("called"), tail("pos").alias("tp"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("called") + F.col("total"), F.lit(0)), F.lit(0.0))
    return (
        scored.withColumn("f1", f1)
        .groupBy(*group).agg(F.max(F.struct("f1", (-F.col("i")).alias("neg"))).alias("b"))
        .select(*group, (-F.col("b.neg") / F.lit(float(steps))).alias("threshold"), F.col("b.f1").alias("f1"))
    )


def weighted_log_loss(df: DataFrame, group: Sequence[str], truth: str, score: str,
                      weights: tuple[float, float], eps: float = 1e-15) -> DataFrame:
    """Mean of ``-w[class] * ln(probability of the true class)``, with clipped probabilities."""
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    loss = F.when(F.col(truth) == 1, -F.lit(weights[1]) * F.ln(p)).otherwise(
        -F.lit(weights[0]) * F.ln(1 - p))
    return df.groupBy(*group).agg(F.avg(loss).alias("log_loss"))


def class_share_from_loss(score: Column) -> Column:
    """Share of class 1 that explains the log loss of a constant submission on a balanced probe."""
    ln = lambda x: F.ln(F.lit(x))
    return (6 * score - 5 * ln(2.0) - ln(1.25)) / (ln(5.0) - ln(1.25))


def pair_correlation(df: DataFrame, group: Sequence[str], model: str, key: str, score: str) -> DataFrame:
    """Pearson correlation for every pair of models within each group (long form, a < b)."""
    group = list(group)
    return (
        model_pairs(df, [*group, key], model, score)
        .groupBy(*group, "model_a", "model_b").agg(F.corr("value_a", "value_b").alias("corr"))
    )


def model_pairs(df: DataFrame, keys: Sequence[str], model: str, value: str) -> DataFrame:
    """One row per key and unordered model pair. A key's array is as long as the list of models,
    which one shuffle brings together, so there is no self join."""
    held = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(value).alias("v")))).alias("xs"))
    first = held.select(*keys, "xs", F.posexplode("xs").alias("i", "a"))
    return first.select(
        *keys, "a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b")
    ).select(*keys, F.col("a.m").alias("model_a"), F.col("b.m").alias("model_b"),
             F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"))


class GiniEvaluator(Evaluator):
    """The Gini score as a spark.ml evaluator, for tuning with ``CrossValidator``."""

    def __init__(self, labelCol: str = "label", probabilityCol: str = "probability", keyCol: str = "id"):
        super().__init__()
        self.labelCol, self.probabilityCol, self.keyCol = labelCol, probabilityCol, keyCol

    def _evaluate(self, dataset: DataFrame) -> float:
        from pyspark.ml.functions import vector_to_array

        scored = dataset.select(
            F.col(self.labelCol).alias("truth"), F.col(self.keyCol).alias("k"),
            vector_to_array(self.probabilityCol)[1].alias("p"))
        row = normalized_gini(scored, [], "truth", "p", "k").first()
        return float(row["gini"]) if row["gini"] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True
