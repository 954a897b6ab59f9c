"""Substring deduplication: every word under a window that stands anywhere else goes.

Recompression (``parsing``) gives equal stretches of text equal symbols. Each window is answered for by one anchor, the stretch that
decided one of its symbols; Spark counts the anchors of the whole corpus, and only windows whose anchor stands twice are named
themselves (128 bits) and counted. So what is shuffled per window is what is repeated, not the corpus. Documents of equal word
sequences are one class: they are removed whole, and only one of them answers for their windows.

Cases: null, empty and blank texts have no words; texts shorter than a window lose nothing. A window that overlaps its own
repeat counts as repeated. Rows are told apart by id and text: repeated rows are copies of each other, and rows of one id with
different texts, or of null id, are documents like others. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.common import WordHasher, drop_written, split_words, text_digest, written
from featherloom.llm.parsing import BASE2, Powers, Windows

ROWS = 64


def _tools():
    return WordHasher(), (Powers(), Powers(BASE2))


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, n, sha, anchors) of (doc_id, digest, text): word count, sha256 of the words, the anchors of all windows (twice what may stand twice)."""

    def run(batches):
        hasher, powers = _tools()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, cols = batch.slice(at, ROWS), [[], [], []]
                for t in part.column("text").to_pylist():
                    words = split_words(t)
                    plain = b" ".join(words)
                    cols[0].append(len(words))
                    cols[1].append(hashlib.sha256(plain).digest())
                    if len(words) < window:
                        cols[2].append(np.empty(0, np.int64))
                        continue
                    w = Windows(hasher.one(plain), window, powers)
                    found = np.unique(w.anchor)
                    cols[2].append(np.concatenate([found, np.intersect1d(found, w.twice, assume_unique=True)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64()))],
                                                 ["doc_id", "digest", "n", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, n bigint, sha binary, anchors array<bigint>")


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, class, at, names): windows of (class, text, hits) whose anchor is among the hits, neighbours of one anchor in a row."""

    def run(batches):
        hasher, powers = _tools()
        for batch in batches:
            for i in range(batch.num_rows):
                words = split_words(batch.column("text")[i].as_py())
                if len(words) < window:
                    continue
                w = Windows(hasher.one(b" ".join(words)), window, powers)
                hits = np.asarray(batch.column("hits")[i].values).astype(np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(w.anchor, hits))
                if not len(at):
                    continue
                new = np.concatenate([[True], (np.diff(at) > 1) | (w.anchor[at[1:]] != w.anchor[at[:-1]])])
                first = np.flatnonzero(new)
                names = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(at)]]), pa.int32()), pa.array(w.whole[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.anchor[at[first]].view(np.int64)), pa.array(np.full(len(first), batch.column("class")[i].as_py()), pa.int64()),
                     pa.array(at[first], pa.int32()), names], ["anchor", "class", "at", "names"])

    return docs.mapInArrow(run, "anchor bigint, class bigint, at int, names array<bigint>")


def cut_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no window at ``starts`` covers."""
    step = np.zeros(len(words) + 1, np.int64)
    starts = starts[starts + window <= len(words)]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _rows_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``docs`` joined with the classes that they stand for, by id and digest."""
    named = classes.withColumn("id_", F.col("row.doc_id")).withColumn("digest_", F.col("row.digest")).drop("row")
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))).drop("id_", "digest_")


def repeated_windows(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, digest, text): (doc_id, n, sha, copies) of every row, where ``copies`` counts rows of the same words; and (sha, row, starts), the
    repeated windows of each class of one row, with its id and digest in ``row``."""
    survey = written(_survey(docs, window), "substring-survey")
    # a class is a word sequence; its number is fixed by the written table, and one of its rows stands for it when the text is read again
    classes = written(survey.where(F.col("n") >= window).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "digest")).alias("row"),
                                                                         F.first("anchors").alias("anchors")).withColumn("class", F.monotonically_increasing_id()), "substring-classes")
    anchors = classes.select("class", F.explode("anchors").alias("anchor"))
    twice = written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "substring-anchors")
    hits = anchors.distinct().join(twice, "anchor").groupBy("class").agg(F.collect_list("anchor").alias("hits"))
    hits = written(hits.join(classes.select("class", "row"), "class"), "substring-hits")
    drop_written(twice)
    runs = written(_candidates(_rows_of(docs, hits).select("class", "text", "hits"), window), "substring-runs")
    each = runs.select("anchor", "class", "at", F.posexplode("names").alias("i", "name"))
    double = written(each.select("anchor", "name", "class", (F.col("at") + F.col("i")).alias("p")).groupBy("anchor", "name")
                     .agg(F.min(F.struct("class", "p")).alias("lo"), F.max(F.struct("class", "p")).alias("hi")).where("lo <> hi").select("anchor", "name"), "substring-names")
    starts = each.join(double, ["anchor", "name"]).groupBy("class").agg(F.collect_set(F.col("at") + F.col("i")).alias("starts"))
    rows = survey.select("doc_id", "n", "sha").join(classes.select("sha", "copies").where("copies > 1"), "sha", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    single = classes.where("copies = 1").select("class", "sha", "row")
    return rows, written(starts.join(single, "class").select("sha", "row", "starts"), "substring-starts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row for each row of ``docs``.

    ``kept`` holds the kept words joined by a blank where something was removed, and is null where the text stays as it is.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    rows, starts = repeated_windows(base, window)

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, kept, shas, removed = batch.slice(at, ROWS), [], [], []
                for t, s in zip(part.column("text").to_pylist(), part.column("starts"), strict=True):
                    words = split_words(t)
                    left = cut_words(words, np.asarray(s.values).astype(np.int64), window)
                    kept.append(b" ".join(left))
                    shas.append(hashlib.sha256(kept[-1]).digest())
                    removed.append(len(words) - len(left))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), pa.array(removed, pa.int64()), pa.array(shas, pa.binary()),
                                                  pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], ["id_", "sha_", "removed", "cut_sha", "kept"])

    changed = _rows_of(base, starts).select("doc_id", "sha", "text", "starts").mapInArrow(cut, "id_ bigint, sha_ binary, removed bigint, cut_sha binary, kept string")
    whole = F.col("copies") > 1        # only texts of a window or more have copies counted
    empty = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    # the id beside the sha spreads texts without words, which share one sha
    return rows.join(changed, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left").select(
        "doc_id", F.col("n").alias("n_words"), F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(whole, empty).otherwise(F.coalesce("cut_sha", "sha")))).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"))
