"""Vectors in blocks: which rows take part, and rows packed so that one row of a frame is a small matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 1 << 18      # of doubles in one packed block


def usable(v: Column) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_rows(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the usable rows, components as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(usable(F.col("v")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch, vector: str = "v"):
    """(dim, row numbers, matrix) for each length of vector in a batch."""
    col = batch.column(batch.schema.get_field_index(vector))
    sizes = np.diff(np.asarray(col.offsets))
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, matrix(col.take(pa.array(at)), int(d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_rows(dim: int) -> int:
    return max(16, BLOCK_BYTES // (8 * dim))
