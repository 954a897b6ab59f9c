"""Boosted trees by histograms, for all folds at once.

Features are cut into bins of equal width. In every round each row has a gradient and a hessian for each fold's model; tasks add them up
by (model, node, feature, bin) in numpy, for all models together, one grouped sum joins these, and running sums over the bins give the gain of
every split. Gradients and hessians are whole multiples of 2 ** -20, so sums are exact in any order and reruns, and other engines, get the same trees.
Only the best split of each node and the value of each leaf come to the driver: (models x nodes) rows. Rows are written once a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.session import stored

GRAIN = 1 << 20


@dataclass
class Tree:
    """Splits of the inner nodes, level by level (feature number, last bin that goes left), and values of the leaves."""

    feature: list[int] = field(default_factory=list)
    last_left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self, bins: Column, depth: int) -> Column:
        """Number of the node of level ``depth`` that a row reaches."""
        at = F.lit(0)
        for level in range(depth):
            here = at + F.lit(2**level - 1)
            right = F.get(bins, F.get(F.lit(self.feature), here)) > F.get(F.lit(self.last_left), here)
            at = at * 2 + right.cast("int")
        return at


@dataclass
class Boosted:
    """Trees of each fold's model, and the bins of its features."""

    features: list[str]
    low: list[float]
    high: list[float]
    bins: int
    depth: int
    models: list[list[Tree]]

    def binned(self) -> Column:
        """The bins of a row's features as an array; values outside the range seen in training go to the outer bins."""
        def one(name: str, low: float, high: float) -> Column:
            if not high > low:
                return F.lit(0)
            at = F.floor((F.col(name).cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(self.bins)))
            return F.greatest(F.least(at, F.lit(self.bins - 1)), F.lit(0)).cast("int")

        return F.array(*[one(*f) for f in zip(self.features, self.low, self.high, strict=True)])

    def margin(self, model: int, bins: Column) -> Column:
        total = F.lit(0.0)
        for tree in self.models[model]:
            total = total + F.get(F.lit(tree.value), tree.node(bins, self.depth))
        return total

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., p): the mean probability of all models."""
        binned = df.withColumn("_bins", self.binned())
        p = [1 / (1 + F.exp(-self.margin(m, F.col("_bins")))) for m in range(len(self.models))]
        return binned.select(*keep, (sum(p[1:], p[0]) / len(p)).alias("p"))


def _whole(x: np.ndarray) -> np.ndarray:
    """Halves away from 0, as Spark and SQL round, in units of the grain."""
    size = np.abs(x * float(GRAIN))
    low = np.floor(size)
    return np.copysign(low + (size - low >= 0.5), x)


def histograms(rows: DataFrame, label: str, fold: str, trees: Sequence[Tree], level: int, features: int, bins: int) -> DataFrame:
    """(model, node, feature, bin, g, h, n) of the rows that each model may see, by their node of level ``level``.

    A task adds up its rows in numpy: folds x nodes x features x bins cells, however many rows. Sums below 2 ** 53 are exact in doubles, so each
    batch is added to whole numbers. A null label has no gradient.
    """
    nodes = 2**level

    def add(batches):
        shape = (len(trees), nodes * features * bins)
        g, h, n, known = (np.zeros(shape, np.int64) for _ in range(4))
        for batch in batches:
            cut = pc.list_flatten(batch.column("bins")).to_numpy().reshape(-1, features)
            margins = pc.list_flatten(batch.column("margins")).to_numpy().reshape(-1, len(trees))
            y = batch.column(label).to_numpy(zero_copy_only=False)
            for m, tree in enumerate(trees):
                sees = np.flatnonzero(pc.fill_null(pc.not_equal(batch.column(fold), m), False).to_numpy(zero_copy_only=False))
                mine, p = cut[sees], 1 / (1 + np.exp(-margins[sees, m]))
                node = np.zeros(len(sees), np.int64)
                for depth in range(level):
                    here = node + 2**depth - 1
                    node = node * 2 + (mine[np.arange(len(sees)), np.array(tree.feature)[here]] > np.array(tree.last_left)[here])
                slope = p - y[sees]
                has = ~np.isnan(slope)
                sums = (_whole(np.where(has, slope, 0.0)), _whole(p * (1 - p)), None, has)
                for f in range(features):
                    cell = (node * features + f) * bins + mine[:, f]
                    for total, w in zip((g, h, n, known), sums, strict=True):
                        total[m] += np.bincount(cell, weights=w, minlength=shape[1]).astype(np.int64)
        m, cell = np.nonzero(n)
        at = lambda x: pa.array(x, pa.int32())
        yield pa.RecordBatch.from_arrays([at(m), at(cell // (features * bins)), at(cell // bins % features), at(cell % bins), pa.array(g[m, cell], mask=known[m, cell] == 0),
                                          pa.array(h[m, cell]), pa.array(n[m, cell])], ["model", "node", "feature", "bin", "g", "h", "n"])

    made = rows.select("bins", "margins", F.col(label).cast("double").alias(label), F.col(fold).cast("long").alias(fold)).mapInArrow(
        add, "model int, node int, feature int, bin int, g bigint, h bigint, n bigint")
    return made.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def best_splits(hist: DataFrame, reg: float) -> DataFrame:
    """(model, node, feature, last_left, and the sums gl and hl of its left side) of the highest gain above 0 from rows (model, node, feature, bin, g, h, n); ties to the smaller feature, then bin.

    A group of the windows is one feature of one node: as many rows as bins.
    """
    upto = Window.partitionBy("model", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("model", "node", "feature")
    sums = hist.select("model", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    part = lambda g, h: g.cast("double") * g.cast("double") / (h.cast("double") + F.lit(reg * GRAIN))
    c = F.col
    gain = part(c("gl"), c("hl")) + part(c("g") - c("gl"), c("h") - c("hl")) - part(c("g"), c("h"))
    open_ones = sums.withColumn("gain", gain).where((c("nl") < c("n")) & (c("gain") > 0))
    best = F.min_by(F.struct("feature", F.col("bin").alias("last_left"), "gl", "hl"), F.struct((-c("gain")).alias("lost"), "feature", "bin")).alias("s")
    return open_ones.groupBy("model", "node").agg(best).select("model", "node", "s.*")


def fit_boosted(rows: DataFrame, key: str, label: str, features: Sequence[str], fold: str, folds: int, rounds: int = 10, depth: int = 2, bins: int = 32,
                rate: float = 0.3, reg: float = 1.0) -> tuple[Boosted, DataFrame]:
    """(models, out-of-fold predictions (key, label, fold, p)): model k learns from the rows of all other folds.

    Labels are 0 or 1; features are numbers without nulls. A node without a split that gains sends all its rows left.
    """
    features = list(features)
    ends = rows.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(features) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    low, high = ([float(ends[f"{n}{i}"] or 0.0) for i in range(len(features))] for n in ("lo", "hi"))
    made = Boosted(features, low, high, bins, depth, [[] for _ in range(folds)])
    now = rows.select(key, F.col(label).cast("double").alias(label), fold, made.binned().alias("bins"), F.array(*[F.lit(0.0)] * folds).alias("margins"))
    for r in range(rounds):
        now = stored(now, "boost")
        trees = [Tree() for _ in range(folds)]
        found, whole = {}, []
        for level in range(max(depth, 1)):
            hist = histograms(now, label, fold, trees, level, len(features), bins)
            if level >= depth - 1:         # the last level's sums also give the leaves
                hist = stored(hist, "histograms")
                whole = hist.where("feature = 0").groupBy("model", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()      # folds x 2 ** level rows
            if level == depth:
                break
            found = {(s["model"], s["node"]): s for s in best_splits(hist, reg).collect()}       # folds x 2 ** level rows
            for m, tree in enumerate(trees):
                for node in range(2**level):
                    split = found.get((m, node))
                    tree.feature.append(split["feature"] if split else 0)
                    tree.last_left.append(split["last_left"] if split else bins)
        value = {}
        leaf = lambda g, h: -rate * g / (h + reg * GRAIN)
        for s in whole:
            at, split = (s["model"], s["node"]), found.get((s["model"], s["node"]))
            g, h = s["g"] or 0, s["h"] or 0
            left = (split["gl"], split["hl"]) if split else (g, h)
            value[at[0], at[1] * 2 if depth else 0] = leaf(*left)
            if split:
                value[at[0], at[1] * 2 + 1] = leaf(g - left[0], h - left[1])
        for m, tree in enumerate(trees):
            tree.value = [value.get((m, n), 0.0) for n in range(2**depth)]
            made.models[m].append(tree)
        now = now.withColumn("margins", F.array(*[F.get("margins", F.lit(m)) + F.get(F.lit(t.value), t.node(F.col("bins"), depth)) for m, t in enumerate(trees)]))
    own = F.get("margins", F.col(fold).cast("int"))
    return made, stored(now, "boost").select(key, label, fold, (1 / (1 + F.exp(-own))).alias("p"))


def permutation_importance(made: Boosted, rows: DataFrame, key: str, label: str, fold: str, order: Column, loss_places: int = 9) -> DataFrame:
    """(feature, loss, share): how much the mean out-of-fold log loss rises when a feature's values are dealt anew within each fold.

    Row i of a fold in the order of its key takes the value of the row that ``order`` (a number for each row, a keyed hash, say) puts at place i.
    Both orders are ranked by slices, never in one task. Shares are of the rises above 0.
    """
    from featherloom.operators.ranking import ordered_prefix

    binned = stored(rows.select(key, F.col(label).cast("double").alias(label), fold, made.binned().alias("bins"), order.alias("_order")), "permute")
    by_key = ordered_prefix(binned, [fold], [F.col(key)], row_number="_at")
    by_order = ordered_prefix(binned.select(fold, key, F.col("bins").alias("_other"), "_order"), [fold], [F.col("_order"), F.col(key)], row_number="_at")
    both = stored(by_key.drop("_order").join(by_order.select(fold, "_at", "_other"), [fold, "_at"]), "permuted")

    def loss(bins: Column) -> Column:
        margin = F.lit(None).cast("double")
        for m in range(len(made.models)):
            margin = F.when(F.col(fold) == m, made.margin(m, bins)).otherwise(margin)
        p = 1 / (1 + F.exp(-margin))
        return F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))

    swapped = lambda j: F.transform("bins", lambda b, i: F.when(i == j, F.get("_other", F.lit(j))).otherwise(b))
    row = both.agg(loss(F.col("bins")).alias("base"), *[loss(swapped(j)).alias(f"loss{j}") for j in range(len(made.features))])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.round(F.col(f"loss{j}") - F.col("base"), loss_places).alias("loss")) for j, name in enumerate(made.features)])).alias("e")).select("e.*")
    rise = F.greatest("loss", F.lit(0.0))
    return long.crossJoin(F.broadcast(long.agg(F.sum(rise).alias("_all")))).select("feature", "loss", F.coalesce(rise / F.nullif("_all", F.lit(0.0)), F.lit(0.0)).alias("share"))   # one row
