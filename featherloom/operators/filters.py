"""Row filters and validity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def keep_listed(df: DataFrame, col: str, listed: DataFrame, listed_col: str) -> DataFrame:
    """Rows whose value is in another frame's column. Catalyst picks the join by the real size."""
    names = listed.select(F.col(listed_col).alias(col)).distinct()
    return df.join(names, col, "left_semi")


def drop_flagged(df: DataFrame, col: str, flag) -> DataFrame:
    """Rows without the flag value; null is kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(flag)))


# fixed values: the two dashes that stand for "no value"
PLACEHOLDERS = ("-", "─")


def keep_real(df: DataFrame, key: str, value: str, header: str | None = None) -> DataFrame:
    """A non-empty key and a value that is not a placeholder; ``header`` also drops a header line."""
    k, v = F.trim(F.col(key).cast("string")), F.trim(F.col(value))
    keep = (k != "") & ~v.isin(*PLACEHOLDERS)
    if header is not None:
        keep = keep & (k != header)
    return df.where(keep)


def drop_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Remove listed rows (outliers) by key."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "bad")


def assert_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = [row["rule"] for row in violations(df, rules).where("bad > 0").collect()]
    if broken:
        raise ValueError(f"rows break the rules {broken}")
    return df


def blank_unknown(df: DataFrame, col: str, known: DataFrame, known_col: str) -> DataFrame:
    """Values outside a dictionary become empty text."""
    names = known.select(F.col(known_col).alias(col)).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(names, col, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(col)).otherwise("").alias(col) if c == col else F.col(c)
        for c in df.columns])


def has_any_token(text: Column | str, words: Sequence[str]) -> Column:
    """True if any blank-separated token of the text is one of the words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.arrays_overlap(F.split(text, r"\s+"), F.array(*[F.lit(w) for w in words]))


# fixed values: units that mark a token as a measurement
UNIT_MARKS = ("mm", "cm")


def keep_words(tokens: DataFrame, token: str, stop_words: Sequence[str]) -> DataFrame:
    """Drop tokens that are integers, contain a unit mark or are stop words."""
    t = F.col(token)
    keep = ~t.rlike(r"^[-+]?\d+$") & ~t.isin(*stop_words)
    for u in UNIT_MARKS:
        keep = keep & ~t.contains(u)
    return tokens.where(keep)
