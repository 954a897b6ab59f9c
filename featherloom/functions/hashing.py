"""Deterministic hashes of keys. They replace random generators: same key, same place, every run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 2 ** 27  # fixed value: the split is defined on the SHA-1 digest modulo 2^27


def key_hash(*parts: Column | str) -> Column:
    """SHA-1 of the ``|``-joined parts, modulo 2^27 (its low 27 bits sit in the last 7 hex digits)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = cols[0].cast("string") if len(cols) == 1 else F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha1(text), 34, 7), 16, 10).cast("long") % F.lit(HASH_RANGE)


def hash_percent(*parts: Column | str) -> Column:
    """The hash scaled to [0, 100]; both ends are reachable."""
    return key_hash(*parts) * F.lit(100.0) / F.lit(float(HASH_RANGE - 1))
