"""Bitmaps of fixed size that say which slots hold something: filters that let too much pass, never too little."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from featherloom.llm.common import drop_written, written

BUCKET = 1 << 15      # bits in one piece of Spark's bitmap aggregate
MOST_SLOTS = 1 << 28  # of a key filter: 32 MB


def bitmap_size(rows: int, most: int) -> int:
    """Slots for a bitmap over so many keys: a power of two, 16 a key, at least 2 ** 16 and at most ``most``."""
    return min(max(1 << 16, 1 << (16 * max(rows, 1) - 1).bit_length()), most)


def bitmap_of(slots: DataFrame, size: int, slot: str = "slot") -> np.ndarray:
    """The bitmap of the slots in a frame (numbers under ``size``; repeats are harmless), built in Spark by pieces.

    The driver receives size / 8 bytes at most, whatever the number of rows.
    """
    one_up = F.col(slot) + 1     # Spark's first piece takes the values 1 to 32768
    pieces = slots.groupBy(F.bitmap_bucket_number(one_up).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_up)).alias("bits"))
    out = np.zeros((max(size, BUCKET) // 8,), np.uint8)
    for row in pieces.toLocalIterator():
        at = (row["piece"] - 1) * BUCKET // 8
        out[at : at + BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is set."""
    at = slots.astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def same_key(keys: list[str], other: str) -> Column:
    """Whether the columns ``keys`` equal those with ``other`` behind their names, nulls being equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{other}")) for k in keys])


class KeyFilter:
    """A bitmap over the keys of a frame, as a table of pieces that are joined by broadcast (``MOST_SLOTS`` bits at most): a test in
    the JVM that passes all keys of the frame and few others."""

    def __init__(self, frame: DataFrame, keys: list[str], seed: int = 0, most: int = MOST_SLOTS):
        self.keys, self.seed, self.count = keys, seed, frame.count()
        self.size = bitmap_size(self.count, most)
        one_up = self._slot() + 1
        self.pieces = written(frame.groupBy(F.bitmap_bucket_number(one_up).alias("piece__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_up)).alias("bits__")), "bits-pieces")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *self.keys), F.lit(self.size))

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """Add ``name``: whether the row's key may be one of the frame's."""
        at = F.col("slot__") % BUCKET
        byte = F.conv(F.hex(F.substr("bits__", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        placed = df.withColumn("slot__", self._slot()).withColumn("piece__", F.floor(F.col("slot__") / BUCKET) + 1)
        return (placed.join(F.broadcast(self.pieces), "piece__", "left")
                .select(*df.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name)))


class KeyTest:
    """Tells the keys of ``inside`` from the others among ``every`` without moving the rows that carry them: a filter of the keys, and one of the
    other keys that pass it. Only rows that pass both have to be looked up; ``open`` says whether there can be any."""

    def __init__(self, inside: DataFrame, every: DataFrame, keys: list[str], most: int = MOST_SLOTS):
        self.first = KeyFilter(inside, keys, 0, most)
        passed = self.first.mark(every.select(*keys), "in__").where("in__").select(*keys).distinct()
        wrong = written(passed.join(inside.select(*[F.col(k).alias(f"{k}__") for k in keys]), same_key(keys, "__"), "left_anti"), "bits-wrong")
        self.second = KeyFilter(wrong, keys, 1, most)
        self.open = self.second.count > 0
        drop_written(wrong)

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """Add ``name``: 1 for keys of ``inside``, 0 for others, -1 for what must be looked up."""
        both = self.second.mark(self.first.mark(df, "one__"), "two__")
        return both.select(*df.columns, F.when(~F.col("one__"), 0).when(F.col("two__"), -1).otherwise(1).alias(name))
