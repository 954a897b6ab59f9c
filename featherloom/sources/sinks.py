"""Sinks. Each replaces its target as a whole; formats are applied only here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from featherloom.session import scratch_path


def write_csv(df: DataFrame, path: str, floats: Sequence[str] = (), fmt: str = "%.7f") -> str:
    """CSV with a header and a fixed format for the float columns."""
    out = df.withColumns({c: F.format_string(fmt, F.col(c)) for c in floats}) if floats else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_tsv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("sep", "\t").csv(path)
    return path


def write_json_lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_lines(df: DataFrame, line: str, path: str) -> str:
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)
    return path


def write_word_vectors(df: DataFrame, word: str, vec: str, path: str) -> str:
    line = F.concat_ws(" ", F.col(word).cast("string"), F.array_join(F.col(vec).cast("array<string>"), " "))
    return write_lines(df.select(line.alias("value")), "value", path)


def save_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder as Parquet and read it back: later steps start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class TableStore:
    """A named table over Parquet files: create, append, and query with SQL."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path or scratch_path(spark, name)

    def create(self, df: DataFrame) -> "TableStore":
        df.write.mode("overwrite").parquet(self.path)
        return self._view()

    def insert(self, df: DataFrame) -> "TableStore":
        df.write.mode("append").parquet(self.path)
        return self._view()

    def _view(self) -> "TableStore":
        self.spark.read.parquet(self.path).createOrReplaceTempView(self.name)
        return self

    def newest_first(self, key: str) -> DataFrame:
        return self.spark.table(self.name).orderBy(F.col(key).desc())
