"""Fixed-length numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fit_length(arr: Column | str, n: int, value=0, side: str = "post", cut: str | None = None) -> Column:
    """Pad and cut to length n. ``side`` is where padding goes, ``cut`` the end that is cut off."""
    a, cut = _col(arr), cut or side
    kept = F.when(F.size(a) <= n, a).otherwise(
        F.slice(a, 1, n) if cut == "post" else F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n))
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(kept, pad) if side == "post" else F.concat(pad, kept)


def min_max_signed(arr: Column | str) -> Column:
    """Scale to [-1, 1]; an array with zero range becomes all -1."""
    a = _col(arr)
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    return F.transform(a, lambda x: 2 * F.coalesce((x.cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) - 1)


def circular_shift(arr: Column | str, k: Column | int) -> Column:
    """Rotate right by k places."""
    a = _col(arr)
    k = F.pmod(F.lit(k) if isinstance(k, int) else k, F.greatest(F.size(a), F.lit(1)))
    return F.when(k == 0, a).otherwise(
        F.concat(F.slice(a, F.size(a) - k + 1, F.greatest(k, F.lit(0))), F.slice(a, F.lit(1), F.size(a) - k)))


def scaled_sum(a: Column | str, b: Column | str, wa: float, wb: float) -> Column:
    """``wa * a + wb * b`` by position; the shorter array counts 0 beyond its end."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.zip_with(_col(a), _col(b), lambda x, y: zero(x) * wa + zero(y) * wb)


def total(arr: Column | str) -> Column:
    return F.aggregate(_col(arr), F.lit(0.0), lambda acc, x: acc + x)


def is_silent(arr: Column | str, eps: float = 1e-5) -> Column:
    return F.abs(total(arr)) <= eps


def k_largest(arr: Column | str, k: int) -> Column:
    return F.slice(F.sort_array(_col(arr), asc=False), 1, k)


def norm(arr: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(arr), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector has zero length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
