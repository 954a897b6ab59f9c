"""Coded survey rows: three yes/no answers to a class, and counts over the whole code table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featherloom.functions.scalars import bit_code

# fixed values: code = household member drives, driver flag, household vehicle used; 0 = owner,
# 1 = borrower
CODE_CLASS = {
    "000": 0,
    "001": 1,
    "010": 0,
    "011": 0,
    "100": 0,
    "101": 1,
    "110": 1,
    "111": 0,
}
CODE_FIELDS = ("HHMEMDRV", "DRVR_FLG", "TRPHHVEH")


def explain_code(code: str) -> str:
    return ", ".join(f"{field}:{'YES' if bit == '1' else 'NO'}" for field, bit in zip(CODE_FIELDS, code))


def code_table(spark) -> DataFrame:
    """The eight codes with their explanation and class (a literal table)."""
    return spark.createDataFrame(
        [(code, explain_code(code), kind) for code, kind in CODE_CLASS.items()],
        "code string, explanation string, kind int")


def classify_codes(df: DataFrame, cols: list[str], yes: str = "01", no: str = "02") -> DataFrame:
    """Rows with a valid code and their class; any other answer drops the row."""
    coded = df.withColumn("code", bit_code(cols, yes, no))
    table = code_table(df.sparkSession).select("code", "kind")
    return coded.join(F.broadcast(table), "code")  # eight rows


def count_codes(classified: DataFrame) -> DataFrame:
    """One row per code of the table, with zero for codes that did not occur."""
    counts = classified.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return code_table(classified.sparkSession).join(F.broadcast(counts), "code", "left").select(
        "code", "explanation", "kind", F.coalesce("n", F.lit(0)).alias("n"))  # at most eight counts
