"""Near-duplicate vectors: spherical k-means puts vectors into cells, blocked cosine products compare within cells.

Equal vectors are one node with a multiplicity. A node lives in the cell of its nearest centre and visits every cell in
which a linked vector may live: if x.c_home - x.c_j is small against the distance of the two centres. That is certain: y lives in j, so
y.(c_home - c_j) <= 0, and x - (x.y)y is no longer than sqrt(1 - t * t), so x.(c_home - c_j) is at most that times the distance.
A vector is written once, in a block of its cell. Two blocks meet where each has vectors that visit the cell of the other, once for both orders:
blocks stream past one another in Spark's product of partitions, so that nothing is written or shuffled for a visit. Cells of any size are cut
into blocks; a task holds two blocks.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length
neither. Rows with equal vectors link with each other. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.common import drop_written, written
from featherloom.llm.components import block_forest, connected_components
from featherloom.llm.vectors import by_dim, matrix, unit, usable, usable_rows

SAMPLE = 20_000          # vectors that centres are fitted on, at most
CELL = 8_000             # vectors a cell aims at
MOST_CELLS = 2_048       # centres stay this few, so that they can be broadcast; larger cells are cut into more blocks
BLOCK_BYTES = 4 << 20    # of doubles in one packed block at most
LEAST_ROWS = 256         # a block has no fewer, where there are more, just to give every core its blocks
STREAMS = 16             # partitions of blocks that pass by a block, at most
STRIP = 1024             # rows of a product of two blocks that are held at a time


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows: centres are unit means; an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ centres.T
        home = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        far = np.argsort(sims[np.arange(len(x)), home])[: len(empty)]
        sums[empty] = x[far]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _slack(threshold: float) -> float:
    """What the length of x - (x.y)y is at most for linked unit rows x and y."""
    # a negative x.y turns the sign of y's part, so then only |x - y| bounds
    return float(np.sqrt(max(1 - threshold**2, 0)) if threshold >= 0 else np.sqrt(2 - 2 * threshold))


def _visits(x: np.ndarray, centres: np.ndarray, home: int, cells: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the rows of one cell visit which ``cells``, as a matrix."""
    gap = np.sqrt(np.maximum(2 - 2 * centres[cells] @ centres[home], 0))
    return (x @ centres[home])[:, None] - x @ centres[cells].T <= _slack(threshold) * gap + 1e-7     # gap errs by 2e-8 where centres meet


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id), one row for each row of ``rows``; links have cosine ``threshold`` or more, in doubles."""
    # the second hash starts from another seed; with the number behind the vector it would follow from the first
    digest = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    keyed = usable_rows(rows, id_col, vector).where("vec_id is not null").select("vec_id", digest.alias("key"), "v")
    nodes = written(keyed.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v")), "cells-nodes")
    shape = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, n = (shape[0]["d"], shape[0]["count"]) if shape else (0, 0)
    k = max(1, min(MOST_CELLS, n // CELL))
    sample = nodes.where(F.size("v") == dim).select("v", F.xxhash64("node").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    centres = fit_centres(unit(matrix(sample.column("v").combine_chunks(), dim)), k) if n else np.zeros((1, 1))
    held = nodes.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            ids, mult = np.asarray(batch.column("node")), np.asarray(batch.column("m"))
            for d, at, x in by_dim(batch):
                x = unit(x)
                home = (x @ held.value.T).argmax(axis=1) if d == held.value.shape[1] else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), pa.array(home, pa.int32()), pa.array(ids[at], pa.int64()),
                                                  pa.array(mult[at], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["d", "cell", "node", "m", "v"])

    placed = made = written(nodes.select("node", "m", "v").mapInArrow(place, "d int, cell int, node bigint, m bigint, v binary"), "cells-placed")
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    per = F.greatest(F.lit(16), F.least(F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d"))), F.lit(max(LEAST_ROWS, -(-n // (2 * cores))))))
    parts = placed.groupBy("d", "cell").count().select(F.col("d").alias("d_"), F.col("cell").alias("cell_"), F.ceil(F.col("count") / per).alias("parts"))
    n_blocks = parts.agg(F.sum("parts")).first()[0] or 1
    placed = placed.join(parts, (F.col("d") == F.col("d_")) & (F.col("cell") == F.col("cell_"))).select(
        "d", "cell", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "m", "v")

    def pack(table):
        one = lambda c: [table.column(c)[0]]
        vecs, d = b"".join(table.column("v").to_pylist()), one("d")[0].as_py()
        centres, visits = held.value, np.zeros(1, int)
        if d == centres.shape[1]:
            x = np.frombuffer(vecs, np.float64).reshape(-1, d)
            visits = np.flatnonzero(_visits(x, centres, one("cell")[0].as_py(), np.arange(len(centres)), threshold).any(axis=0))
        return pa.table({"d": one("d"), "cell": one("cell"), "part": one("part"), "visits": [visits.tolist()], "nodes": [np.asarray(table.column("node")).tobytes()],
                         "mult": [np.asarray(table.column("m")).tobytes()], "vecs": [vecs]},
                        schema=pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("visits", pa.list_(pa.int32())), ("nodes", pa.binary()), ("mult", pa.binary()), ("vecs", pa.binary())]))

    blocks = written(placed.groupBy("d", "cell", "part").applyInArrow(pack, "d int, cell int, part int, visits array<int>, nodes binary, mult binary, vecs binary"), "cells-blocks")

    def side(row, c):
        nodes, mult = (np.frombuffer(row[f"{c}_{name}"], np.int64) for name in ("nodes", "mult"))
        return nodes, mult, np.frombuffer(row[f"{c}_vecs"], np.float64).reshape(len(nodes), -1)

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                (xs, x_mult, x), (ys, y_mult, y) = side(row, "x"), side(row, "y")
                home, other, same = row["x_cell"], row["y_cell"], (row["x_cell"], row["x_part"]) == (row["y_cell"], row["y_part"])
                if home != other:      # only vectors that visit the cell of the others
                    go, come = _visits(x, held.value, home, np.array([other]), threshold)[:, 0], _visits(y, held.value, other, np.array([home]), threshold)[:, 0]
                    xs, x_mult, x, ys, y_mult, y = xs[go], x_mult[go], x[go], ys[come], y_mult[come], y[come]
                single, back = y.astype(np.float32).T, np.zeros(len(ys), np.int64)
                for lo in range(0, len(xs), STRIP):
                    mine = x[lo : lo + STRIP]
                    # single precision finds what may be a link, a double sum over the pair's components decides
                    r, c = np.nonzero(mine.astype(np.float32) @ single >= threshold - 1e-4)
                    ok = xs[lo + r] != ys[c]
                    r, c = r[ok], c[ok]
                    ok = np.concatenate([(mine[r[at : at + 8192]] * y[c[at : at + 8192]]).sum(axis=1) for at in range(0, len(r), 8192)] or [np.empty(0)]) >= threshold
                    r, c = r[ok], c[ok]
                    if not len(r):
                        continue
                    count = np.bincount(r, y_mult[c], len(mine)).astype(np.int64)
                    if not same:
                        back += np.bincount(c, x_mult[lo + r], len(ys)).astype(np.int64)
                    names, at = xs[lo : lo + STRIP], np.flatnonzero(count)
                    tree = block_forest(r, c, names, ys)
                    node, near, n_ = (np.concatenate(p) for p in ((names[at], tree[:, 0]), (names[at], tree[:, 1]), (count[at], np.zeros(len(tree), np.int64))))
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(n_, pa.int64())], ["u", "v", "n"])
                at = np.flatnonzero(back)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ys[at], pa.int64()), pa.array(ys[at], pa.int64()), pa.array(back[at], pa.int64())], ["u", "v", "n"])

    sides = {c: blocks.select(*[F.col(name).alias(f"{c}_{name}") for name in blocks.columns]) for c in "xy"}
    x = sides["x"].repartitionByRange(min(n_blocks, STREAMS), "x_d", "x_cell", "x_part")      # stream past
    y = sides["y"].repartitionByRange(n_blocks, "y_d", "y_cell", "y_part")                    # a block in each, which a task holds
    first = (F.col("x_cell") < F.col("y_cell")) | ((F.col("x_cell") == F.col("y_cell")) & (F.col("x_part") <= F.col("y_part")))
    meet = F.array_contains("x_visits", F.col("y_cell")) & F.array_contains("y_visits", F.col("x_cell"))
    pairs = x.hint("shuffle_replicate_nl").crossJoin(y).where((F.col("x_d") <= F.col("y_d")) & (F.col("x_d") >= F.col("y_d")) & first & meet)
    found = written(pairs.drop("x_d", "y_d", "x_visits", "y_visits").mapInArrow(compare, "u bigint, v bigint, n bigint"), "cells-links")
    drop_written(blocks, made)
    counts = found.groupBy("u").agg(F.sum("n").alias("others")).withColumnRenamed("u", "node")
    comps = connected_components(found.where("u <> v").select("u", "v"))
    classes = written(nodes.select("key", "node", "m").join(counts, "node", "left").join(comps, "node", "left").select(
        "key", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "cells-classes")
    drop_written(nodes, found, comps)
    v = F.col(f"`{vector}`").cast("array<double>")
    key = F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), digest)
    every = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).select("vec_id", key.alias("key"))
    linked = every.where("key is not null").join(classes, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                                                F.coalesce("component_id", "vec_id").alias("component_id"))
    # vectors that take no part stay out of the join, where they would meet in one task
    return linked.unionByName(every.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
