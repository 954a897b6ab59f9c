"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector is turned by a fixed random rotation; the signs of its components, packed, are its code, and the inner product of
the vector with its own sign vector is kept as correction. The inner product of a query with the sign vector over that correction
estimates the cosine, and its error has a known scale, sqrt((1 - f * f) / f * f / (dim - 1)). A block's vectors whose estimate
plus ``bound`` of these errors does not reach the k-th best cosine known so far are left; the others are compared exactly, in the
same task. The index is a table of blocks (ids, codes, corrections, vectors); queries come in blocks too, and every block of
queries meets every block of the index: both sides are cut into shares of a fixed size, and a share of each meet under one key of a join.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id; vectors of another
length than the query's are no candidates. Rows of one id count once, with the largest cosine of any of them, on either side. With fewer than k candidates, all are returned. No
rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from featherloom.llm.common import written
from featherloom.llm.vectors import block_rows, by_dim, unit, usable_rows
from featherloom.session import input_bytes

TILE_BYTES = 64 << 20     # of either side in one tile


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and corrections of unit rows."""
    t = x @ turn.T
    return np.packbits(t >= 0, axis=1), np.abs(t).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(q: np.ndarray, codes: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries by vectors) of turned unit queries, and one standard error per vector."""
    d = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    dots = q.astype(np.float32) @ signs.T / np.sqrt(d)
    return dots / f, np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(d - 1, 1))


def blocks(rows: DataFrame, codes: bool) -> DataFrame:
    """(d, ids, raw[, codes, f]): rows (vec_id, v) packed into blocks as they come, with codes for an index."""

    def pack(batches):
        kept: dict[int, list] = {}

        def out(d, rows_):
            ids, x = np.concatenate([i for i, _ in rows_]), np.concatenate([v for _, v in rows_])
            step = block_rows(d)
            for lo in range(0, len(ids), step):
                part = x[lo : lo + step]
                bits, f = encode(unit(part), rotation(d)) if codes else (np.empty(0, np.uint8), np.empty(0))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (ids[lo : lo + step], part, bits, f)],
                                                 ["d", "ids", "raw", "codes", "f"])

        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            for d, at, x in by_dim(batch):
                kept.setdefault(d, []).append((ids[at], x))
                if sum(len(i) for i, _ in kept[d]) >= block_rows(d):
                    yield from out(d, kept.pop(d))
        for d, rows_ in kept.items():
            yield from out(d, rows_)

    return rows.mapInArrow(pack, "d int, ids binary, raw binary, codes binary, f binary")


def _shares(index: DataFrame, asked: DataFrame) -> tuple[int, int]:
    """Shares of the index and of the queries, about ``TILE_BYTES`` each; at least a tile for each core, whatever the size."""
    least = index.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-input_bytes(index) // TILE_BYTES)), max(1, -(-input_bytes(asked) // TILE_BYTES))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, bound: float = 4.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each query, itself left out, ties to the smaller id."""
    ready = lambda df: usable_rows(df, id_col, vector).where("vec_id is not null")
    index = written(blocks(ready(rows), codes=True), "onebit-index")
    asked = written(blocks(ready(queries), codes=False), "onebit-queries")

    def search(batches):
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                d = row["d"]
                if d != row["qd"]:      # asked here: as a join condition it would be the only key, and hot
                    continue
                qid, ids = np.frombuffer(row["qid"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = (np.frombuffer(row[c], np.float64).reshape(-1, d) for c in ("q", "raw"))
                codes, f = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["f"])
                est, err = estimate(unit(q) @ rotation(d).T, codes, f)
                low, high = est - bound * err, est + bound * err
                norm_x, norm_q = (np.sqrt((m * m).sum(axis=1)) for m in (x, q))
                single = len(np.unique(ids)) == len(ids)     # else the k best rows may be of fewer ids
                for j, name in enumerate(qid.tolist()):
                    got = best.setdefault(name, {})
                    least = -np.inf
                    if single and len(ids) > k:
                        least = np.partition(low[j], len(ids) - k - 1)[len(ids) - k - 1]     # the query itself may be among them
                    if len(got) == k:
                        least = max(least, min(got.values()))
                    at = np.flatnonzero((high[j] >= least) & (ids != name))
                    exact = (x[at] * q[j]).sum(axis=1) / (norm_x[at] * norm_q[j])
                    if single and len(at) > 4 * k:
                        cut = np.partition(exact, len(at) - k)[len(at) - k]
                        at, exact = at[exact >= cut], exact[exact >= cut]
                    for s, v in zip(exact.tolist(), ids[at].tolist(), strict=True):
                        got[v] = max(s, got.get(v, s))
                    best[name] = dict(sorted(got.items(), key=lambda r: (-r[1], r[0]))[:k])
        rows_ = [(name, v, s) for name, found in best.items() for v, s in found.items()]
        for lo in range(0, len(rows_), 10_000):
            part = rows_[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    # a tile is a share of the index and a share of the queries: both sides are dealt by tile, so that neither has to fit into a task
    share = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wide, deep = _shares(index, asked)
    left = index.withColumn("ti", share(wide)).withColumn("tq", each(deep)).withColumn("tile", F.col("ti") * deep + F.col("tq"))
    right = asked.withColumn("tq", share(deep)).withColumn("ti", each(wide)).select(
        (F.col("ti") * deep + F.col("tq")).alias("tile"), F.col("d").alias("qd"), F.col("ids").alias("qid"), F.col("raw").alias("q"))
    pairs = left.drop("ti", "tq").join(right, "tile").drop("tile")
    found = written(pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double"), "onebit-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
