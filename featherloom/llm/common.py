"""Helpers of this subpackage: word splitting, hashing, and tables written under the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featherloom.session import scratch_path, ship_package

#: Fixed by the contracts: a word is a longest run of anything but these separators.
WORD = r"[^\x20\x09-\x0D]+"

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    """128 bits of a text, null for null: with the id, what tells rows apart where ids repeat or are null."""
    return F.unhex(F.md5(text.cast("binary")))


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside give Python workers their rows in batches of at most ``BATCH_BYTES``."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet under the shared folder and read it back.

    The lineage ends at the files, which outlive any executor. Python workers get their rows in batches of ``BATCH_BYTES``.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for df in frames:
        spark, path = df.sparkSession, df.written_at
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split cuts at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FACTOR_SEED = 0xC2B2AE3D
ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts, computed on whole chunks of bytes; no word becomes a Python object.

    A word's letters are multiplied by drawn odd factors, one for each place, and summed: over the draw of the factors, any two
    words meet with a probability of 2 ** -56 at most. (Powers of one base would be the same for certain pairs of words whatever the base.)
    """

    def __init__(self, lower: bool = False):
        self.lower, self.factors = lower, np.empty(0, np.uint64)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word of the texts data[bounds[i]:bounds[i + 1]], in order."""
        word = ~SEPARATOR[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = bounds[:-1][bounds[:-1] < len(data)]
        first[heads] = word[heads]
        at = np.flatnonzero(word)
        start = np.flatnonzero(first)
        if not len(start):
            return np.empty(0, np.uint64), start
        rank = np.cumsum(word)[start] - 1
        size = np.diff(rank, append=len(at))
        if size.max() > len(self.factors):     # one stream: longer draws begin like shorter ones
            self.factors = np.random.PCG64(FACTOR_SEED).random_raw(1 << int(size.max()).bit_length()) | np.uint64(1)
        letters = (LOWER[data] if self.lower else data)[at].astype(np.uint64) + np.uint64(1)
        letters *= self.factors[np.arange(len(at)) - np.repeat(rank, size)]
        with np.errstate(over="ignore"):
            return mix64(np.add.reduceat(letters, rank) + size.astype(np.uint64) * ODD), start

    def one(self, data: bytes) -> np.ndarray:
        return self.of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]

    def each(self, texts: pa.Array):
        """The word hashes of each text of an Arrow array, null as empty."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            hi = min(hi, len(texts))
            h, start = self.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cut = np.searchsorted(start, offsets[lo : hi + 1] - offsets[lo])
            for i in range(hi - lo):
                yield h[cut[i] : cut[i + 1]]
            lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def release() -> None:
    """At the end of a task: give the pages that Arrow holds for later batches back, as a worker may idle for long."""
    pa.default_memory_pool().release_unused()


def base_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash with internal ones."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])
