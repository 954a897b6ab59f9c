"""Learning on spark.ml: out-of-fold prediction, stacking, tuning, importance, word vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.operators.ensemble import logit_mean as mean_in_logit_space, mean_by_key
from featherloom.operators.evaluate import GiniEvaluator, roc_auc
from featherloom.operators.textfeat import n_grams
from featherloom.session import durable, stored


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., features vector). A null or NaN feature is an error: impute first, so that no row is lost."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vec.transform(df).select(*keep, "features")


def text_features(df: DataFrame, key: str, text: str, keep: Sequence[str] = (), max_n: int = 2, min_df: int = 3,
                  *, max_features: int) -> DataFrame:
    """(key, keep..., features): L2-normalised TF-IDF of word n-grams as sparse vectors; the ``max_features`` most frequent terms."""
    grams = df.select(key, *keep, F.concat(*[n_grams(text, "word", n) for n in range(1, max_n + 1)]).alias("grams"))
    stages = [CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=max_features, minDF=min_df),
              IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")]
    return Pipeline(stages=stages).fit(grams).transform(grams).select(key, *keep, "features")


def positive_score(predicted: DataFrame) -> Column:
    """Probability of class 1, or the margin's logistic where the model has no probability."""
    if "probability" in predicted.columns:
        return vector_to_array("probability")[1]
    return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))


def oof(train: DataFrame, estimator: Estimator, key: str, label: str, k: int, fold: str = "fold",
        test: DataFrame | None = None, logit_mean: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions (key, label, fold, p), and for ``test`` the mean over the fold models
    (of the probabilities, or in logit space).

    The estimator needs its label column set to ``label``. The features are cut from their lineage
    once, because every fold reads them again.
    """
    train = durable(train)
    valid_parts, test_parts = [], []
    for i in range(k):
        model = estimator.fit(train.where(F.col(fold) != i))
        predicted = model.transform(train.where(F.col(fold) == i))
        valid_parts.append(predicted.select(key, label, fold, positive_score(predicted).alias("p")))
        if test is not None:
            scored = model.transform(test)
            test_parts.append(scored.select(key, positive_score(scored).alias("p")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    if test is None:
        return union(valid_parts), None
    average = mean_in_logit_space if logit_mean else mean_by_key
    return union(valid_parts), average(union(test_parts), [key], "p").withColumnRenamed("score", "p")


def base_predictions(train: DataFrame, estimators: Mapping[str, Estimator], key: str, label: str, k: int,
                     fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions of several models side by side: (key, label, fold, one column per model)."""
    parts = [oof(train, est, key, label, k, fold)[0].withColumn("model", F.lit(name)) for name, est in estimators.items()]
    long = reduce(DataFrame.unionByName, parts)
    return long.groupBy(key, label, fold).agg(
        *[F.max(F.when(F.col("model") == name, F.col("p"))).alias(name) for name in estimators])


def fold_grams(base: DataFrame, models: Sequence[str], label: str, fold: str) -> dict[int, list[list[float]]]:
    """For each fold the sums of products of (1, models..., label): all that least squares needs, from one aggregate."""
    cols = [F.lit(1.0), *[F.col(m).cast("double") for m in models], F.col(label).cast("double")]
    n = len(cols)
    cells = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    rows = base.groupBy(fold).agg(*cells).collect()       # a row for each fold
    return {r[fold]: [[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)] for r in rows}


def solve_positive(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a positive definite system by elimination in the given order."""
    n = len(b)
    a, b = [list(r) for r in a], list(b)
    for i in range(n):
        for j in range(i + 1, n):
            f = a[j][i] / a[i][i]
            a[j] = [x - f * y for x, y in zip(a[j], a[i], strict=True)]
            b[j] -= f * b[i]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (b[i] - sum(a[i][j] * x[j] for j in range(i + 1, n))) / a[i][i]
    return x


def stack_weights(grams: dict[int, list[list[float]]], chosen: Sequence[int], k: int, ridge: float) -> list[list[float]]:
    """For each of the k folds (intercept, weights of the chosen columns) of ridge regression on all other folds.

    Every subset is solved from the same sums; the intercept is not penalised but for what keeps it defined without rows.
    """
    out = []
    at = [0, *chosen]
    for fold in range(k):
        others = [g for f, g in grams.items() if f != fold]
        total = lambda i, j: sum((g[i][j] for g in others), 0.0)  # noqa: E731, B023
        a = [[total(i, j) + (ridge if i == j and i else 1e-9 if i == j else 0.0) for j in at] for i in at]
        out.append(solve_positive(a, [total(i, -1) for i in at]))
    return out


def search_subsets(base: DataFrame, models: Sequence[str], label: str, k: int, fold: str = "fold", smallest: int = 2, ridge: float = 1.0) -> DataFrame:
    """AUC, out of fold, of a ridge stacker for every subset of at least ``smallest`` base models: (models, auc).

    One scan gives the sums by fold for all subsets and folds, a second one scores every row by all stackers.
    """
    base = stored(base, "base")
    grams = fold_grams(base, models, label, fold)
    scores = []
    for size in range(smallest, len(models) + 1):
        for chosen in combinations(range(len(models)), size):
            weights = stack_weights(grams, [c + 1 for c in chosen], k, ridge)
            here = lambda i: F.get(F.lit([w[i] for w in weights]), F.col(fold).cast("int"))  # noqa: E731, B023
            total = here(0)
            for i, c in enumerate(chosen):
                total = total + here(i + 1) * F.col(models[c])
            scores.append(F.struct(F.lit("+".join(models[c] for c in chosen)).alias("models"), F.round(total, 9).alias("p")))
    long = base.select(F.col(label).cast("int").alias("truth"), F.explode(F.array(*scores)).alias("e")).select("truth", "e.*")
    return roc_auc(long, ["models"], "truth", "p")


def tune(train: DataFrame, estimator: Estimator, grid: Mapping, key: str, label: str, k: int, fold: str = "fold",
         parallelism: int = 2, draws: int | None = None, seed: int = 7):
    """Search on the given folds by the Gini score; returns the cross-validated model.

    The whole grid is tried, or with ``draws`` so many points of it, drawn by a seeded hash of their values without repeats.
    """
    build = ParamGridBuilder()
    for param, values in grid.items():
        build = build.addGrid(param, values)
    points = build.build()
    if draws is not None:
        drawn = lambda point: hashlib.sha256(repr((seed, sorted((p.name, v) for p, v in point.items()))).encode()).digest()
        points = sorted(points, key=drawn)[:draws]
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=points, numFolds=k, foldCol=fold,
                        parallelism=parallelism, evaluator=GiniEvaluator(labelCol=label, keyCol=key))
    return cv.fit(durable(train))


def tuning_report(model, spark) -> DataFrame:
    """(params, gini) of the grid, best first: one row per grid point."""
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(g))
            for m, g in zip(model.getEstimatorParamMaps(), model.avgMetrics)]
    return spark.createDataFrame(rows, "params string, gini double").orderBy(F.col("gini").desc(), "params")


def importance_table(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, share, scaled): importance as a share of the sum, and min-max scaled."""
    values = [float(v) for v in model.featureImportances.toArray()]
    total, low, high = sum(values) or 1.0, min(values), max(values)
    rows = [(f, v / total, (v - low) / ((high - low) or 1.0)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, share double, scaled double")


def correlation_report(df: DataFrame, watched: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """(side, position, name, corr): the k highest and the k lowest correlations with a column."""
    row = df.agg(*[F.corr(watched, c).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "name", "corr")
    top = lambda order: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "name"))  # one row per column
    side = lambda name, order: long.withColumn("position", top(order)).where(F.col("position") <= k).withColumn("side", F.lit(name))
    return side("top", F.col("corr").desc()).unionByName(side("bottom", F.col("corr"))).select("side", "position", "name", "corr")
