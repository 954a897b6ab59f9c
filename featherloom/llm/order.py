"""Token ids in training order: every sequence gets a slot by a keyed permutation, and slots become fixed-stride binary shards.

Texts are encoded once and cut into sequences, which are written as a table; a sequence's number is its place in that table (the
rows of the tasks before, and its row). A Feistel network over the next even number of bits, walked until it falls below the count, turns numbers into
slots one to one. Shard ``s`` holds slots ``s * per_shard`` and on, each in ``stride`` bytes, so slot ``t`` is at byte ``(t % per_shard) *
stride`` of shard ``t // per_shard``: a reader starts at any slot and goes on in order. Range partitions by shard write the shards.

Cases: null and empty texts have no sequence. A last sequence is filled up with the end id; its true length is kept. Long texts give
as many sequences as they need. Repeated rows give their sequences again. No rows give no shards. Other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.common import drop_written, small_batches
from featherloom.session import scratch_path

ROWS = 128
PARTITION_BYTES = 32 << 20     # of shards that one task writes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def feistel(x: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of range(count), for each element of ``x``; walks again from values beyond the count."""
    half = np.uint64(max(1, ((max(count, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}/{r}".encode())) for r in range(rounds)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            m = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((m ^ (m >> np.uint64(32))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(x.astype(np.uint64))
        while len(again := np.flatnonzero(out >= count)):
            out[again] = once(out[again])
    return out.astype(np.int64)


def sequences(docs: DataFrame, ranks: dict[bytes, int], pattern: str, length: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, n_tokens, ids): each text's ids in pieces of ``length``, 2 bytes an id (4 where the vocabulary needs it)."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)     # as large as the vocabulary
    kind = _kind(len(ranks))

    def run(batches):
        coder = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=held.value, special_tokens={})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), ([], [], [], [])
                for name, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array(coder.encode_ordinary(t) if t else [], kind)
                    for p in range(0, len(ids), length):
                        piece = ids[p : p + length]
                        for column, value in zip(out, (name, p // length, len(piece), piece.tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                                 ["doc_id", "part", "n_tokens", "ids"])

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, "doc_id bigint, part int, n_tokens int, ids binary")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary < 1 << 16 else "<u4"


def write_shards(docs: DataFrame, ranks: dict[bytes, int], pattern: str, path: str, length: int = 512, per_shard: int = 512, key: int = 1,
                 id_col: str = "doc_id", text: str = "text") -> int:
    """Write the shards as Parquet rows (shard, first_slot, count, stride, payload, doc_ids, parts, sizes), in order of shard; gives the number of slots."""
    spark = docs.sparkSession
    kind, end = _kind(len(ranks)), len(ranks)
    stride = length * np.dtype(kind).itemsize
    table = scratch_path(spark, "order-sequences")
    with small_batches(spark):
        sequences(docs, ranks, pattern, length, id_col, text).write.option("compression", "zstd").parquet(table)
    rows = spark.read.schema("doc_id bigint, part int, n_tokens int, ids binary").parquet(table)
    task = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    numbered = rows.select(task.alias("task"), F.col("_metadata.row_index").alias("row"), "doc_id", "part", "n_tokens", "ids")
    counts = {r["task"]: r["count"] for r in numbered.groupBy("task").count().collect()}     # a number for each task of one write
    sizes = np.zeros(max(counts, default=0) + 1, np.int64)
    sizes[list(counts)] = list(counts.values())
    total = int(sizes.sum())
    offsets = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)

    def place(batches):
        for batch in batches:
            slot = feistel(offsets.value[np.asarray(batch.column("task"))] + np.asarray(batch.column("row")), total, key)
            names = ["doc_id", "part", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot)] + [batch.column(n) for n in names], ["shard", "slot", *names])

    placed = numbered.mapInArrow(place, "shard bigint, slot bigint, doc_id bigint, part int, n_tokens int, ids binary")

    def pack(batches):
        held: list[tuple] = []

        def out():
            pad = np.full(length, end, kind).tobytes()
            payload = b"".join(r[3] + pad[len(r[3]) :] for r in held)
            shard = held[0][0] // per_shard
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((shard, pa.int64()), (held[0][0], pa.int64()), (len(held), pa.int32()), (stride, pa.int32()), (payload, pa.binary()),
                                               ([r[1] for r in held], pa.list_(pa.int64())), ([r[2] for r in held], pa.list_(pa.int32())),
                                               ([r[4] for r in held], pa.list_(pa.int32())))],
                ["shard", "first_slot", "count", "stride", "payload", "doc_ids", "parts", "sizes"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("slot", "doc_id", "part", "ids", "n_tokens")), strict=True):
                if held and row[0] // per_shard != held[0][0] // per_shard:
                    yield from out()
                    held = []
                held.append(row)
        if held:
            yield from out()

    parts = max(1, -(-total * stride // PARTITION_BYTES))
    packed = (placed.repartitionByRange(parts, "shard").sortWithinPartitions("slot")
              .mapInArrow(pack, "shard bigint, first_slot bigint, count int, stride int, payload binary, doc_ids array<bigint>, parts array<int>, sizes array<int>"))
    with small_batches(spark):
        packed.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    rows.written_at = table
    drop_written(rows)
    return total


def read_shards(spark, path: str, from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, ids) of the written slots from ``from_slot`` on; whole shards before it are skipped by their column."""
    shards = spark.read.parquet(path).where(F.col("first_slot") + F.col("count") > from_slot)

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                n, stride = row["count"], row["stride"]
                wide = [k for k in range(n) if row["first_slot"] + k >= from_slot]
                for lo in range(0, len(wide), 512):
                    ks = wide[lo : lo + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["first_slot"] + k for k in ks], pa.int64()), pa.array([row["shard"]] * len(ks), pa.int64()), pa.array([k * stride for k in ks], pa.int64()),
                         pa.array([row["doc_ids"][k] for k in ks], pa.int64()), pa.array([row["parts"][k] for k in ks], pa.int32()),
                         pa.array([row["sizes"][k] for k in ks], pa.int32()), pa.array([row["payload"][k * stride : (k + 1) * stride] for k in ks], pa.binary())],
                        ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids"])

    return shards.mapInArrow(cut, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, part int, n_tokens int, ids binary")
