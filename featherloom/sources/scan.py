"""Scans of text formats. Schemas are given, never inferred; large files split across tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, na: str = "-1",
             header: bool = True) -> DataFrame:
    """CSV with a sentinel for missing values. The sentinel is matched as text by the reader and, for
    floating-point columns, by value as well (``-1.0`` is the same sentinel)."""
    df = spark.read.schema(schema).option("header", header).option("nullValue", na).csv(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[
        F.nullif(F.col(c), F.lit(float(na)).cast(dict(df.dtypes)[c])).alias(c) if c in floats else F.col(c)
        for c in df.columns])


def scan_text_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", quote: str = '"',
                  header: bool = True) -> DataFrame:
    """CSV with every column as text; later operators cast what they need."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", quote).csv(path)


def scan_tsv(spark: SparkSession, path: str, columns: Sequence[str], rename: Mapping[str, str] | None = None,
             header: bool = False) -> DataFrame:
    df = scan_text_csv(spark, path, columns, sep="\t", header=header)
    return df.withColumnsRenamed(dict(rename)) if rename else df


def scan_positions(spark: SparkSession, path: str, positions: Mapping[str, int], sep: str = ",") -> DataFrame:
    """Fields picked by position from raw lines; lines without all of them are dropped."""
    parts = F.split(F.trim("value"), sep)
    return spark.read.text(path).where(F.size(parts) > max(positions.values())).select(
        *[F.trim(F.get(parts, F.lit(i))).alias(name) for name, i in positions.items()])


def scan_documents(spark: SparkSession, path: str, name_glob: str = "*",
                   id_pattern: str = r"[^/_]*_([^/_]*)[^/]*$") -> DataFrame:
    """(id, path, content) of whole files in nested folders; hidden folders are skipped.

    The id is by default the second ``_`` field of the file name.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name_glob)
    where = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_extract(where, id_pattern, 1).alias("id"), where.alias("path"), F.col("value").alias("content"))


def scan_predictions(spark: SparkSession, path: str, schema: str, model_pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """All prediction files of a folder in one scan, with the model name taken from the path."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), model_pattern, 1).alias("model"), *df.columns)


def scan_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from lines ``word v1 ... vn``."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"))
