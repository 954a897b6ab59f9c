"""Exact duplicates by progressive refinement: by length, then by a hash of the beginning, then by a hash of everything.

Texts are equal when they are identical after the six separators (space, tab, LF, VT, FF, CR) are deleted. One scan gives every
text its length and the hash of its first ``HEAD`` bytes; lengths that only one text has end there, then beginnings that only one
text of its length has. What is still open is read again and hashed whole (SHA-256), and only these rows are grouped. Which
lengths and beginnings are shared is kept in bitmaps of a bounded size: when they fill up, more texts than needed are hashed
whole, and the result is the same. Texts never move; rows of some dozens of bytes do.

Cases: null text is empty text, and all texts without other characters are equal. Ids may repeat or be null; of equal texts the row with
the most code points stays, then the one of smallest id (null last), then the first read. Extra columns are left alone. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.bits import bitmap_of, bitmap_size, in_bitmap
from featherloom.llm.common import drop_written, release, written

HEAD = 256                   # bytes of the beginning that are hashed
LENGTH_SLOTS = 1 << 21       # lengths up to a million have a slot of their own, longer ones share
MOST_SLOTS = 1 << 28         # 32 MB
SALTS = 64                   # parts in which a large group of copies is counted and answered
CONTINUATION = bytes(range(0x80, 0xC0))


def bare(text: bytes | None) -> tuple[bytes, int, int]:
    """(text without separators, its code points, code points of the whole) of a UTF-8 text."""
    text = text or b""
    rest = b"".join(text.split())         # bytes.split cuts at exactly the six separators
    points = len(text.translate(None, CONTINUATION))
    return rest, points - (len(text) - len(rest)), points


def _length_slot(size: np.ndarray) -> np.ndarray:
    half = LENGTH_SLOTS // 2
    return np.where(size < half, size, half + size % half)


def _head(rest: bytes, size: int) -> int:
    return xxhash.xxh64_intdigest(rest[:HEAD], seed=size) >> 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digests: bool = False, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row.

    ``digest`` is the SHA-256 of the text without separators, null for texts told apart without it unless ``digests`` asks for all.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def look(batches):
        for batch in batches:
            seen = [(size, _head(rest, size)) for rest, size, _ in map(bare, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.int64()), pa.array([h for _, h in seen], pa.int64())], ["size", "head"])
        release()

    heads = written(base.select("text").mapInArrow(look, "size bigint, head bigint"), "exact-heads")
    half = LENGTH_SLOTS // 2
    slot = F.when(F.col("size") < half, F.col("size")).otherwise(half + F.col("size") % half)
    shared = heads.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = spark.sparkContext.broadcast(bitmap_of(shared, LENGTH_SLOTS))

    def same_length(batches):
        for batch in batches:
            size = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(in_bitmap(lengths.value, _length_slot(size))))], ["head"])

    rows = heads.count()
    slots = bitmap_size(rows, most_slots)
    open_heads = heads.mapInArrow(same_length, "head bigint").groupBy((F.col("head") % slots).alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    beginnings = spark.sparkContext.broadcast(bitmap_of(open_heads, slots))

    def read(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            seen = [bare(t) for t in texts]
            size = np.array([s for _, s, _ in seen], np.int64)
            head = np.array([_head(rest, s) for rest, s, _ in seen], np.int64)
            still = in_bitmap(lengths.value, _length_slot(size)) & in_bitmap(beginnings.value, head % slots)
            digest = [hashlib.sha256(rest).digest() if digests or yes else None for (rest, _, _), yes in zip(seen, still, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts)), pa.int64()), ids, pa.array([p for _, _, p in seen], pa.int64()), pa.array(still), pa.array(digest, pa.binary())],
                ["row", "doc_id", "points", "open", "digest"])
            row += len(texts)
        release()

    told = written(base.mapInArrow(read, "row bigint, doc_id bigint, points bigint, open boolean, digest binary"), "exact-rows")
    drop_written(heads)
    # counted by (digest, part) first, so that a group of any size is spread, then by digest, then handed back to its parts
    still = told.where("open").withColumn("part", F.pmod("row", F.lit(SALTS)))
    best = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    parts = still.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("first"))
    whole = parts.groupBy("digest").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"), F.collect_list("part").alias("parts"))
    groups = whole.where("group_size > 1").select("digest", "group_size", "first", F.explode("parts").alias("part"))
    answer = still.join(groups, ["digest", "part"], "left")
    alone = F.col("group_size").isNull()
    answer = answer.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                           (alone | (F.col("row") == F.col("first.row"))).alias("kept"), "digest")
    rest = told.where("not open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return answer.unionByName(rest)
