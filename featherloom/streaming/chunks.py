"""Flows and counts over files that arrive in chunks. Both end when the present files are done, and
continue from their checkpoint when more arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featherloom.operators.encode import NAN_TEXT
from featherloom.plans.flow import FittedFlow


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_flow_on_stream(stream: DataFrame, flow: FittedFlow, sink: str, checkpoint: str) -> DataFrame:
    """Apply a flow fitted beforehand to every chunk and append to Parquet (exactly once)."""
    query = flow.transform(stream).writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)


def count_values_on_stream(stream: DataFrame, cols: Sequence[str], checkpoint: str) -> DataFrame:
    """(name, value, n) accumulated over the chunks.

    The counts live in the state store, which survives lost executors; they are read from there as a
    distributed table rather than sent through the driver.
    """
    texts = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit(NAN_TEXT)).alias("value"))
                      for c in cols])
    counts = stream.select(F.inline(texts)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    query = counts.writeStream.format("noop").option("checkpointLocation", checkpoint) \
        .outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    state = stream.sparkSession.read.format("statestore").load(checkpoint)
    return state.select("key.name", "key.value", F.col("value.count").alias("n"))
