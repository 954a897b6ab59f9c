"""Logistic models fitted together against plain numpy steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.operators import evaluate, linear


def data(seed=3, n=90, terms=25):
    rng = np.random.default_rng(seed)
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.3)
    x[7] = 0.0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = (x @ rng.standard_normal(terms) > 0).astype(float)
    return x, a, (rng.random(n) < 0.4).astype(float)


def frames(spark, x, a, b):
    rows = spark.createDataFrame([(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id bigint, term string, w double")
    docs = spark.createDataFrame([(i, i % 3, int(a[i]), None if i == 11 else int(b[i])) for i in range(len(a))], "id bigint, fold int, a int, b int")
    return rows, docs.repartition(4)


def steps(x, y, sees, n, rate, penalty, scale=1.0):
    z = x * scale
    w, c, w0, c0 = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 1 / (1 / rate + penalty)
    for k in range(n):
        push = k / (k + 3)
        v, d = w + push * (w - w0), c + push * (c - c0)
        r = 1 / (1 + np.exp(-(z[sees] @ v + d))) - y[sees]
        w0, c0 = w, c
        w, c = v - rate * (z[sees].T @ r / sees.sum() + penalty * v), d - rate * r.mean()
    return 1 / (1 + np.exp(-(z @ w + c)))


def test_all_labels_folds_and_penalties_take_the_plain_steps(spark):
    x, a, b = data()
    rows, docs = frames(spark, x, a, b)
    got = linear.oof_logistic(rows, docs, "id", ["a", "b"], 3, penalties=[0.0, 0.5], steps=6).collect()
    assert len(got) == 90 * 2 * 2
    fold, known = np.arange(90) % 3, np.arange(90) != 11
    for label, y in (("a", a), ("b", b)):
        for c in (0.0, 0.5):
            for k in range(3):
                p = steps(x, y, (fold != k) & (known if label == "b" else True), 6, 2.0, c)
                mine = {r["id"]: r["p"] for r in got if r["label_name"] == label and r["penalty"] == c and r["fold"] == k}
                assert max(abs(mine[i] - p[i]) for i in mine) < 1e-9 and set(mine) == {i for i in range(90) if i % 3 == k}


def test_only_the_most_frequent_terms_count(spark):
    x, a, b = data()
    rows, docs = frames(spark, x, a, b)
    codes = {r["term"]: r["code"] for r in linear.number_terms(rows, 4).collect()}
    df = (x > 0).sum(axis=0)
    assert codes == {f"t{j:02d}": i for i, j in enumerate(sorted(range(25), key=lambda j: (-df[j], j))[:4])}
    top = [int(t[1:]) for t in codes]
    cut = np.zeros_like(x)
    cut[:, top] = x[:, top]
    got = {r["id"]: r["p"] for r in linear.oof_logistic(rows, docs, "id", ["a"], 3, most_terms=4, steps=5).collect()}
    for k in range(3):
        p = steps(cut, a, np.arange(90) % 3 != k, 5, 2.0, 0.0)
        assert all(abs(got[i] - p[i]) < 1e-9 for i in range(k, 90, 3))


def test_search_ranks_penalties_by_gini(spark):
    x, a, b = data(4, 150)
    rows, docs = frames(spark, x, a, b)
    got = {r["penalty"]: r["gini"] for r in linear.search_logistic(rows, docs, "id", "a", 3, penalties=[0.0, 0.01, 100.0], steps=10).collect()}
    assert set(got) == {0.0, 0.01, 100.0} and got[0.0] > 0.4
    scored = linear.oof_logistic(rows, docs, "id", ["a"], 3, penalties=[0.01], steps=10).withColumn("p", F.round("p", 9))
    auc = [r["auc"] for r in evaluate.roc_auc(scored, ["fold"], "truth", "p").collect()]
    assert got[0.01] == pytest.approx(np.mean([2 * v - 1 for v in auc]))
    assert linear.drawn([1.0, 2.0, 3.0], 2, 7) == linear.drawn([3.0, 2.0, 1.0], 2, 7) and len(set(linear.drawn([1.0, 2.0, 3.0], 2, 7))) == 2


def test_ratio_scaled_rows_take_the_plain_steps(spark):
    x, a, b = data(5)
    rows, docs = frames(spark, x, a, b)
    train, test = docs.where("id < 60"), docs.where("id >= 60")
    valid, mean = linear.ratio_scaled_logistic(rows, train, test, "id", ["a"], 3, steps=6, penalty=0.01)
    got, new = {r["id"]: r["p"] for r in valid.collect()}, {r["id"]: r["p"] for r in mean.collect()}
    ps = []
    for k in range(3):
        sees = (np.arange(90) % 3 != k) & (np.arange(90) < 60)
        yes, no = sees & (a == 1), sees & (a == 0)
        ratio = np.log(((1 + x[yes].sum(axis=0)) / (1 + yes.sum())) / ((1 + x[no].sum(axis=0)) / (1 + no.sum())))
        ps.append(steps(x, a, sees, 6, 0.5, 0.01, ratio))
        assert all(abs(got[i] - ps[k][i]) < 1e-9 for i in range(k, 60, 3))
    assert all(abs(new[i] - np.mean([p[i] for p in ps])) < 1e-9 for i in range(60, 90)) and len(got) == 60


def test_nothing_to_learn_from(spark):
    x, a, b = data()
    rows, docs = frames(spark, x, a, b)
    assert linear.oof_logistic(rows, docs.where("false"), "id", ["a"], 3, steps=2).count() == 0
    got = {r["id"]: r["p"] for r in linear.oof_logistic(rows.where("false"), docs, "id", ["a"], 3, steps=2).collect()}
    for k in range(3):
        p = steps(np.zeros((90, 1)), a, np.arange(90) % 3 != k, 2, 2.0, 0.0)
        assert all(abs(got[i] - p[i]) < 1e-12 for i in range(k, 90, 3))


def test_rows_are_made_once(spark):
    x, a, b = data(6)
    rows, docs = frames(spark, x, a, b)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = rows.repartition(3, "id").sortWithinPartitions("id").mapInArrow(count, rows.schema)
    linear.oof_logistic(counted, docs, "id", ["a"], 3, steps=2).collect()
    assert made.value == rows.count()
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    plain, given = (linear.ratio_scaled_logistic(rows if c is None else counted, docs.where("id < 60"), docs.where("id >= 60"), "id", ["a"], 3, steps=3, most_terms=9, counts=c) for c in (None, df))
    for x, y in zip(plain, given, strict=True):
        assert {r["id"]: round(r["p"], 9) for r in x.collect()} == {r["id"]: round(r["p"], 9) for r in y.collect()}
    assert made.value == 2 * rows.count()
