"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled ones (U) train linear numpy classifiers on hashed word and word-head features. The
risk is pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)]) with logistic loss: U's negative risk, less what its
hidden positives (a share pi) put into it, and never below zero; where it would fall below, it gives no step. Weights stay
at zero or above and an L1 step keeps those of words without evidence at zero, so long clean texts gather no score. Each shard of the training rows gets a
classifier of its own, all are averaged, and two numbers (slope and offset) turn the sum into a probability on labelled
rows of the learning part.

Bounds (documented sampling of the fit): ``POSITIVE`` confirmed and ``UNLABELLED`` other documents for the classifiers and ``CALIBRATION`` labelled
ones for slope and offset, drawn by a hash of the id; of rows of one id, one is learnt from. Every document is scored from its whole
text, in the job that reads the result: nothing of the scored rows is written here, and Python gets the text alone.

Cases: null and empty texts get the score of no feature. Null labels are no labels; an id labelled both ways is toxic. Without any
toxic label all scores are 0. Rows without id are scored and never learnt from. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from featherloom.llm.common import drop_written, release, small_batches, written

POSITIVE, UNLABELLED = 12_000, 24_000
CALIBRATION = 30_000
SHARDS, PER_SHARD = 6, 700      # classifiers at most, and the positive rows that one needs
BITS = 18
HEADS = (3, 4, 5, 6)      # lengths of word heads that are features of their own
EDGE = ".,;:!?\"'()[]{}<>|*%$#&@~_-+=/\\"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def word_features(word: str) -> list[int]:
    """Buckets of a lower-case word: itself and its heads."""
    w = word.strip(EDGE)
    if not w:
        return []
    names = [f"={w}"] + [f"{n}^{w[:n]}" for n in HEADS if len(w) > n]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


class Features(dict):
    """Memo of a word's buckets; with ``keep`` only those whose weight is not zero."""

    def __init__(self, keep: np.ndarray | None = None, bound: int = 100_000):
        super().__init__()
        self.keep, self.bound = keep, bound

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.clear()
        got = word_features(word)
        if self.keep is not None:
            got = [i for i in got if self.keep[i]]
        self[word] = got = tuple(got)
        return got

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for w in set(text.lower().split()) if text else ():
            found.update(self[w])
        return sorted(found)


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 200, rate: float = 0.5, l1: float = 1e-4,
             least: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of one classifier: (buckets, weights, offset), by proximal full-batch steps with per-weight rates.

    Only buckets of at least ``least`` positive rows can carry weight; the rest stays at zero.
    """
    n = len(rows)
    who = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    seen = np.bincount(flat[positive[who]], minlength=1 << BITS)
    buckets = np.flatnonzero(seen >= least)
    place = np.full(1 << BITS, -1)
    place[buckets] = np.arange(len(buckets))
    use = place[flat] >= 0
    who, col = who[use], place[flat[use]]
    w, b = np.zeros(len(buckets)), float(np.log(prior / (1 - prior)))
    n_p, n_u = positive.sum(), (~positive).sum()
    if not len(buckets) or not n_p or not n_u:
        return buckets, w, b
    power, power_b = np.full(len(buckets), 1e-8), 1e-8
    for _ in range(steps):
        g = np.bincount(who, w[col], n) + b
        p = 1 / (1 + np.exp(-np.clip(g, -35, 35)))
        loss_neg = np.logaddexp(0, g)
        negative = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        # derivative of the logistic loss in g: p - 1 towards toxic, p towards clean
        up = np.where(positive, prior * (p - 1) / n_p, 0.0)
        down = np.where(positive, -prior * p / n_p, p / n_u)
        slope = up + down if negative >= 0 else up
        grad, grad_b = np.bincount(col, slope[who], len(buckets)), slope.sum()
        power, power_b = power + grad**2, power_b + grad_b**2
        step = rate / np.sqrt(power)
        w = w - step * grad
        w = np.maximum(w - step * l1, 0)
        b -= rate / np.sqrt(power_b) * grad_b
    return buckets, w, b


def _labelled(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``; labels are (doc_id, toxic).

    With ``carry`` the whole input row comes along as a struct ``row``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = written(_labelled(labels).where(~held_out(F.col("doc_id"))), "toxic-labels")
    n_all, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows_of_result = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else [text])]).alias("row"))
    out = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")] + [F.col("row")] * carry
    if not n_toxic:
        return rows_of_result.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shards = max(1, min(SHARDS, n_toxic // PER_SHARD))
    prior = min(max(n_toxic / n_all, 1e-3), 0.5)
    draw = (F.xxhash64("doc_id", F.lit("toxicity")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    positive = known.where("toxic = 1").where(draw < POSITIVE / n_toxic).select("doc_id", F.lit(True).alias("positive"))
    others = (base.select("doc_id").where(~held_out(F.col("doc_id"))).where(draw < UNLABELLED / max(base.count(), 1))
              .join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(False).alias("positive")))
    chosen = written(positive.unionByName(others.distinct()), "toxic-rows")    # POSITIVE + UNLABELLED rows of two columns

    def extract(batches):
        memo = Features()
        for batch in batches:
            got = [np.array(memo.of(t), np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(got, pa.binary())], ["doc_id", "positive", "f"])
        release()

    rows = (base.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInArrow(extract, "doc_id bigint, positive boolean, f binary")
            .groupBy("doc_id", "positive").agg(F.min("f").alias("f")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards))))

    def train(key, table):
        order = np.argsort(np.asarray(table.column("doc_id")), kind="stable")     # the same sums whatever the order of arrival
        f = table.column("f").to_pylist()
        buckets, w, b = fit_nnpu([np.frombuffer(f[i], np.uint32) for i in order], np.asarray(table.column("positive"))[order], prior)
        on = w != 0
        return pa.table({"buckets": pa.array([buckets[on].tolist()], pa.list_(pa.int64())), "weights": pa.array([w[on].tolist()], pa.list_(pa.float64())),
                         "offset": pa.array([b], pa.float64())})

    with small_batches(spark):
        fits = rows.groupBy("shard").applyInArrow(train, "buckets array<bigint>, weights array<double>, offset double").collect()
    weights, offset = np.zeros(1 << BITS), 0.0
    for fit in fits:
        weights[fit["buckets"]] += np.array(fit["weights"]) / len(fits)
        offset += fit["offset"] / len(fits)
    model = spark.sparkContext.broadcast(weights.astype(np.float32))    # 2 ** BITS numbers

    @F.arrow_udf(DoubleType())
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = model.value
        memo = Features(w != 0)
        for texts in batches:
            got = []
            for at in range(0, len(texts), 256):
                got += [float(w[memo.of(t)].sum(dtype=np.float64)) + offset for t in texts.slice(at, 256).to_pylist()]
            yield pa.array(got, pa.float64())
        release()

    sums = sums.asNondeterministic()      # so that the planner asks for each sum once
    drawn = F.xxhash64("doc_id", F.lit("calibration")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30) < CALIBRATION / n_all
    some = written(base.join(F.broadcast(written(known.where(drawn), "toxic-some")), "doc_id").select("doc_id", "toxic", sums(F.col("text")).alias("g")), "toxic-sums")
    bins = (some.groupBy("doc_id", "toxic").agg(F.min("g").alias("g")).groupBy(F.round(F.least(F.greatest("g", F.lit(-40.0)), F.lit(40.0)), 2).alias("g"), "toxic").count().collect())
    slope, shift = _calibrate(np.array([r["g"] for r in bins]), np.array([r["toxic"] for r in bins]), np.array([r["count"] for r in bins], float))
    score = 1 / (1 + F.exp(-(F.col("g") * slope + shift)))
    drop_written(some, chosen, known)
    return rows_of_result.withColumn("g", sums(F.col("row").getField(text))).select(*out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def _calibrate(g: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted bins, by Newton steps; targets are drawn in a little from 0 and 1."""
    if not len(g):
        return 1.0, 0.0
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = np.average(g, weights=n), max(np.sqrt(np.cov(g, fweights=n.astype(int))) if n.sum() > 1 else 1.0, 1e-6)
    x = np.stack([(g - mean) / scale, np.ones_like(g)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        grad = x.T @ (n * (p - t)) + 1e-3 * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        beta -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
    slope = max(beta[0], 0.0) / scale
    return float(slope), float(beta[1] - slope * mean)
