"""Scalar transforms of columns. Null in gives null out unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# fixed values: the two-valued results of lab tests and the display texts of the sex code
POSITIVE, NEGATIVE = "+", "-"
NEGATIVE_MARK = "阴"
MALE, FEMALE = "男", "女"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A text column as double; unparseable text becomes null instead of failing the job."""
    return _col(c).try_cast("double")


def clip_ratio(c: Column | str, low: float, high: float) -> Column:
    """1 at or above ``high``, 0 at or below ``low``, else the 4-digit share in between."""
    x = number(c)
    return F.when(x >= high, F.lit(1.0)).when(x <= low, F.lit(0.0)).when(
        x.isNotNull(), F.round((x - low) / F.lit(float(high - low)), 4))


def level(c: Column | str, low: float, high: float) -> Column:
    """L below the normal interval, M inside (inclusive), H above."""
    x = number(c)
    return F.when(x < low, "L").when(x <= high, "M").when(x.isNotNull(), "H")


def bin_label(c: Column | str, low: int, high: int, gap: int) -> Column:
    """Upper-inclusive bins ``a_b`` of width ``gap``, with ``<low`` and ``>high`` at the ends.

    A value beyond the last whole bin gets ``(high-gap)_high`` even if gap does not divide the span.
    """
    x = number(c)
    upper = F.lit(low) + F.ceil((x - low) / gap) * gap
    inner = F.when(upper < high, F.concat((upper - gap).cast("string"), F.lit("_"), upper.cast("string"))) \
        .otherwise(F.lit(f"{high - gap}_{high}"))
    return F.when(x <= low, F.lit(f"<{low}")).when(x >= high, F.lit(f">{high}")).when(x.isNotNull(), inner)


def is_value(c: Column | str, one) -> Column:
    """1.0 where the value is ``one``, 0.0 elsewhere, nulls included."""
    return _col(c).eqNullSafe(F.lit(one)).cast("double")


def is_present(c: Column | str) -> Column:
    """1 where the text is neither null nor empty."""
    return (_col(c).isNotNull() & (_col(c) != "")).cast("int")


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def plus_one(c: Column | str) -> Column:
    return number(c) + 1


def plus(a: Column | str, b: Column | str) -> Column:
    return number(a) + number(b)


def minus(a: Column | str, b: Column | str) -> Column:
    return number(a) - number(b)


def sign_by_limit(c: Column | str, limit: float = 100.0) -> Column:
    """'+' above the limit, else '-'; the literal ``nan`` passes through."""
    x = _col(c).cast("string")
    return F.when(x == "nan", "nan").when(number(c) > limit, POSITIVE).when(number(c).isNotNull(), NEGATIVE)


def sign_by_text(c: Column | str, limit: float = 4.0) -> Column:
    """Numbers: '+' above the limit, else '-'. Text: '-' if it names a negative finding, else null."""
    x = _col(c).cast("string")
    return F.when(x == "nan", "nan").when(number(c) > limit, POSITIVE).when(
        number(c).isNotNull(), NEGATIVE).when(x.contains(NEGATIVE_MARK), NEGATIVE)


def sex_text(c: Column | str) -> Column:
    return F.when(number(c) == 1, MALE).when(_col(c).isNotNull(), FEMALE)


def merge_signs(a: Column | str, b: Column | str) -> Column:
    """'+' if either is '+', else '-' if either is '-', else null."""
    a, b = _col(a), _col(b)
    either = lambda s: a.eqNullSafe(F.lit(s)) | b.eqNullSafe(F.lit(s))
    return F.when(either(POSITIVE), POSITIVE).when(either(NEGATIVE), NEGATIVE)


def largest(*cols: Column | str) -> Column:
    """Row maximum; NaN counts as missing, because Spark would rank it above every number."""
    clean = [F.nullif(number(c), F.lit(float("nan"))) for c in cols]
    return F.greatest(*clean)


def region_parts(c: Column | str, base: int = 27) -> tuple[Column, Column]:
    """Recover two small integers (quotient, remainder) packed as ``sqrt(base*m + f) / 40``."""
    n = F.bround(F.pow(40 * _col(c), F.lit(2.0)), 0).cast("long")
    rest = F.pmod(n, F.lit(base))
    return (n - rest) / F.lit(base), rest


def region_quotient(c: Column | str, base: int = 27) -> Column:
    return region_parts(c, base)[0].cast("long")


def region_remainder(c: Column | str, base: int = 27) -> Column:
    return region_parts(c, base)[1].cast("long")


# fixed values: base of the packing and the images of the -1 sentinel
REGION31_BASE, REGION31_BAD_A, REGION31_BAD_M = 31, 19, 51


def region31(c: Column | str) -> tuple[Column, Column]:
    """The base-31 form: a multiple of 31 gives remainder 31 and a quotient one lower; the images
    of the missing-value sentinel become -1 in each part on its own."""
    n = F.bround(F.pow(40 * _col(c), F.lit(2.0)), 0).cast("long")
    rest = F.pmod(n, F.lit(REGION31_BASE))
    a = F.when(rest == 0, F.lit(REGION31_BASE)).otherwise(rest).cast("long")
    m = ((n - a) / F.lit(REGION31_BASE)).cast("long")
    return (F.when(a == REGION31_BAD_A, F.lit(-1)).otherwise(a).cast("long"),
            F.when(m == REGION31_BAD_M, F.lit(-1)).otherwise(m).cast("long"))


def combine(a: Column | str, b: Column | str) -> Column:
    """Two values as one category text; a null part reads ``nan``."""
    text = lambda c: F.coalesce(_col(c).cast("string"), F.lit("nan"))
    return F.concat_ws("_", text(a), text(b))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(_col(p), F.lit(eps)), F.lit(1 - eps))
    return F.ln(p / (1 - p))


def inv_logit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def null_count(cols: Sequence[str]) -> Column:
    """How many of the columns are null in a row."""
    out = F.lit(0)
    for c in cols:
        out = out + F.col(c).isNull().cast("int")
    return out


def sentinel_count(cols: Sequence[str], sentinel=-1) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce((F.col(c) == sentinel).cast("int"), F.lit(0))
    return out


def class_value(c: Column | str, table: Mapping, default=None) -> Column:
    """Literal lookup of a small fixed mapping (class weights, relabelling, level codes)."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(_col(c) == F.lit(key), F.lit(value)).otherwise(out)
    return out


def bit_code(cols: Sequence[Column | str], yes: str = "01", no: str = "02") -> Column:
    """One digit per column, 1 for ``yes`` and 0 for ``no``; any other value makes the code null."""
    digit = lambda c: F.when(F.trim(_col(c)) == yes, "1").when(F.trim(_col(c)) == no, "0")
    return F.concat(*[digit(c) for c in cols])


def row_total(cols: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + F.col(c)
    return out


def repair(c: Column | str, digits: Mapping[str, str], bad: Sequence[str]) -> Column:
    """Values containing a key of ``digits`` take its value; values containing a ``bad`` text are null."""
    x = _col(c)
    out = x
    for b in bad:
        out = F.when(x.contains(b), F.lit(None)).otherwise(out)
    for key, value in reversed(list(digits.items())):
        out = F.when(x.contains(key), F.lit(value)).otherwise(out)
    return out
