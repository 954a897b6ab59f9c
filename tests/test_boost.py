"""Boosted trees against a plain rewrite, and permutation importance."""

import math
import random

import pytest
from pyspark.sql import functions as F

from featherloom.operators import boost


def data(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randrange(12) / 4, rng.random()
        rows.append((i, float((a > 1.5) != (b < 0.2)), i % 3, a, round(b, 3), 7.0))
    return rows


def plain(rows, folds, rounds, depth, bins, rate, reg):
    """The same steps, one row at a time."""
    cols = list(zip(*[r[3:] for r in rows]))
    lo, hi = [min(c) for c in cols], [max(c) for c in cols]
    cut = [[0 if hi[j] == lo[j] else min(math.floor((x - lo[j]) / (hi[j] - lo[j]) * bins), bins - 1) for j, x in enumerate(r[3:])] for r in rows]
    out = {}
    for k in range(folds):
        f = [0.0] * len(rows)
        train = [i for i, r in enumerate(rows) if r[2] != k]
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-x)) for x in f]
            g = [math.floor((p[i] - rows[i][1]) * boost.GRAIN + 0.5) for i in range(len(rows))]
            h = [math.floor(p[i] * (1 - p[i]) * boost.GRAIN + 0.5) for i in range(len(rows))]
            node = [0] * len(rows)
            for level in range(depth):
                splits = {}
                for v in range(2**level):
                    mine = [i for i in train if node[i] == v]
                    part = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + reg * boost.GRAIN)
                    best = (0.0, 0, bins)
                    for j in range(len(lo)):
                        for b in range(bins):
                            left = [i for i in mine if cut[i][j] <= b]
                            if 0 < len(left) < len(mine):
                                gain = part(left) + part([i for i in mine if cut[i][j] > b]) - part(mine)
                                if gain > best[0] + 1e-9:
                                    best = (gain, j, b)
                    splits[v] = best[1:]
                node = [2 * v + (cut[i][splits[v][0]] > splits[v][1]) for i, v in enumerate(node)]
            value = {v: -rate * sum(g[i] for i in train if node[i] == v) / (sum(h[i] for i in train if node[i] == v) + reg * boost.GRAIN) for v in range(2**depth)}
            f = [x + value[v] for x, v in zip(f, node)]
        out |= {r[0]: 1 / (1 + math.exp(-f[i])) for i, r in enumerate(rows) if r[2] == k}
    return out


@pytest.mark.parametrize("depth, bins, rounds", [(2, 8, 3), (3, 5, 2)])
def test_boosting_equals_the_plain_steps(spark, depth, bins, rounds):
    rows = data(depth)
    df = spark.createDataFrame(rows, "id bigint, y double, fold int, a double, b double, same double").repartition(5)
    made, got = boost.fit_boosted(df, "id", "y", ["a", "b", "same"], "fold", 3, rounds=rounds, depth=depth, bins=bins)
    want = plain(rows, 3, rounds, depth, bins, 0.3, 1.0)
    assert {r["id"]: round(r["p"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert [len(m) for m in made.models] == [rounds] * 3
    # models score rows that nobody has seen, also far outside the range of training
    far = spark.createDataFrame([(1, 99.0, -5.0, 7.0), (2, -99.0, 5.0, 8.0)], "k int, a double, b double, same double")
    scored = [r["p"] for r in made.score(far, ["k"]).orderBy("k").collect()]
    assert all(0 < p < 1 for p in scored) and scored[0] != scored[1]


def test_one_class_and_constant_features_give_no_split(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2, 3.0) for i in range(10)], "id int, y double, fold int, a double")
    made, got = boost.fit_boosted(df, "id", "y", ["a"], "fold", 2, rounds=2, depth=2, bins=4)
    assert all(t.last_left == [4, 4, 4] for m in made.models for t in m)
    p = {r["p"] for r in got.collect()}
    assert len(p) == 1 and p.pop() > 0.5


def test_importance_finds_the_features_that_matter(spark):
    rows = data(9, 600)
    df = spark.createDataFrame(rows, "id bigint, y double, fold int, a double, b double, same double")
    made, _ = boost.fit_boosted(df, "id", "y", ["a", "b", "same"], "fold", 3, rounds=8, depth=2, bins=16)
    got = {r["feature"]: (r["loss"], r["share"]) for r in boost.permutation_importance(made, df, "id", "y", "fold", F.xxhash64("id")).collect()}
    assert got["same"] == (0.0, 0.0) and got["a"][1] > got["b"][1] > 0
    assert sum(s for _, s in got.values()) == pytest.approx(1.0)


def test_histograms_are_added_up_in_tasks(spark):
    """A row is no row for each model and feature; null labels have no gradient, null folds are in no model, halves round away from 0."""
    half = 1.5 / boost.GRAIN
    rows = [(0, 0.0, [1, 0], [0.0, 1.0]), (1, 1.0, [1, 2], [0.0, -1.0]), (1, None, [0, 2], [0.0, 0.0]), (None, 1.0, [0, 0], [0.0, 0.0]), (1, 0.5 - half, [0, 2], [0.0, 0.0]), (1, 0.5 + half, [3, 1], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "fold int, y double, bins array<int>, margins array<double>").repartition(3)
    trees = [boost.Tree([1], [0]), boost.Tree([0], [0])]
    made = boost.histograms(df, "y", "fold", trees, 1, 2, 4)
    want = {}
    for fold, y, cut, f in rows:
        for m in range(2):
            if fold is None or fold == m:
                continue
            p = 1 / (1 + math.exp(-f[m]))
            node = int(cut[trees[m].feature[0]] > trees[m].last_left[0])
            away = lambda x: math.copysign(math.floor(abs(x) * boost.GRAIN + 0.5), x)
            for j, b in enumerate(cut):
                g, h, n = want.get((m, node, j, b), (None, 0, 0))
                want[m, node, j, b] = (g if y is None else (g or 0) + away(p - y), h + away(p * (1 - p)), n + 1)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in made.collect()} == want
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
