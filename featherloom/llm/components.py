"""Connected components by alternating large-star and small-star, each half a grouped minimum and a join back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.common import drop_written, written

SALTS = 32      # tasks that the neighbours of one node are dealt to


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour to the smallest one: the larger neighbours (large star) or the smaller ones and the node itself."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = with_least(near)
    if large:
        pairs = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def with_least(near: DataFrame) -> DataFrame:
    """(u, v, m): each row (u, v) with the least of u and its neighbours, a node's neighbours being dealt to several tasks.

    The minimum is taken by (node, part), then by node, and handed back to the parts that the node has.
    """
    dealt = near.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_list("part").alias("parts"))
    return dealt.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges are undirected, may repeat, and loops are ignored. Each round ends in a written table, so a lost executor costs one
    round; the result is a written table too, for the caller to drop. Only a count and a checksum come to the driver.
    """
    now = written(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").distinct(), "cc")
    mark, done = _mark(now), False
    while not done and mark[0]:
        wide = written(_star(now, large=True), "cc-large")
        after = written(_star(wide, large=False), "cc-small")
        drop_written(now, wide)
        new = _mark(after)
        done, mark, now = new == mark, new, after
    # all edges now go from a node to the least of its component
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "cc-out")
    drop_written(now)
    return out


def block_forest(r: np.ndarray, c: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node of its part) of the two-sided graph of one pair of blocks, whose links are xs[r] - ys[c]."""
    label_x, label_y = xs.copy(), ys.copy()
    while True:
        lx, ly = label_x.copy(), label_y.copy()
        np.minimum.at(lx, r, label_y[c])
        np.minimum.at(ly, c, lx[r])
        if (lx == label_x).all() and (ly == label_y).all():
            break
        label_x, label_y = lx, ly
    out = np.concatenate([np.stack([xs, label_x], 1), np.stack([ys, label_y], 1)])
    return out[out[:, 0] != out[:, 1]]
