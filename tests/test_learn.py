"""Small runs of the learning operators."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from featherloom.operators import learn


def rows(spark):
    df = spark.range(90).select(F.col("id"), (F.col("id") % 3).cast("int").alias("fold"),
                                ((F.col("id") % 7) > 3).cast("double").alias("y"), (F.col("id") % 7 + F.rand(3)).alias("x"))
    return learn.assemble(df, ["x"], ["id", "y", "fold"])


def test_oof_covers_every_row_once_and_averages_test(spark):
    train = rows(spark)
    test = train.select(F.col("id") + 1000, "features").toDF("id", "features")
    est = LogisticRegression(labelCol="y", maxIter=5)
    valid, mean = learn.oof(train, est, "id", "y", 3, test=test)
    assert valid.count() == valid.select("id").distinct().count() == 90
    assert mean.count() == 90
    _, in_logit = learn.oof(train, est, "id", "y", 3, test=test, logit_mean=True)
    gap = mean.join(in_logit.withColumnRenamed("p", "q"), "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert 0 <= gap < 0.2


def test_importance_sums_to_one(spark):
    class Fitted:
        class featureImportances:
            @staticmethod
            def toArray():
                import numpy as np
                return np.array([3.0, 1.0])
    got = {r["feature"]: (r["share"], r["scaled"]) for r in learn.importance_table(Fitted, ["a", "b"], spark).collect()}
    assert got == {"a": (0.75, 1.0), "b": (0.25, 0.0)}


def test_subsets_are_solved_from_shared_sums(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    y = (rng.random(120) < 0.5).astype(float)
    x = np.clip(y[:, None] * [0.4, 0.2, 0.0] + rng.random((120, 3)) * 0.6, 0, 1)
    fold = np.arange(120) % 4
    df = spark.createDataFrame([(int(f), float(t), *map(float, r)) for f, t, r in zip(fold, y, x)], "fold int, y double, a double, b double, c double").repartition(3)
    got = {r["models"]: r["auc"] for r in learn.search_subsets(df, ["a", "b", "c"], "y", 4).collect()}
    want = {}
    for size in (2, 3):
        for chosen in itertools.combinations(range(3), size):
            p = np.zeros(120)
            for k in range(4):
                z = np.hstack([np.ones((120, 1)), x[:, chosen]])
                train = z[fold != k]
                w = np.linalg.solve(train.T @ train + np.diag([1e-9] + [1.0] * size), train.T @ y[fold != k])
                p[fold == k] = z[fold == k] @ w
            wins = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
            want["+".join("abc"[c] for c in chosen)] = sum(wins) / len(wins)
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)
    assert learn.solve_positive([[4.0, 2.0], [2.0, 3.0]], [2.0, 5.0]) == [-0.5, 2.0]
