"""Session helpers: a tuned session for local runs, and shared scratch space for durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "featherloom", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (AQE on, UTC, no UI port)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, which all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, only a local master may use a temporary folder of
    this machine; on a cluster it is an error, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="featherloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def is_local(master: str) -> bool:
    """Whether a master runs everything in one process (``local-cluster`` does not)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that every reader sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage with a Parquet table under the shared folder: columnar, so later readers take only what they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside give Python workers their rows in batches of few megabytes; a larger row stands alone."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size; reads nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SLICE_BYTES = 128 << 20


def slices_of(df: DataFrame) -> int:
    """Slices for a global order: no fewer than shuffle partitions, and more as the input grows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-input_bytes(df) // SLICE_BYTES)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan of few splits over all cores before expensive work per row.

    Only an input of less than a split per core is moved, and such an input is small; a large one already has enough splits and
    passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if input_bytes(df) < cores * SLICE_BYTES // 4 else df


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give this package to the workers of a session, wherever they were started; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="featherloom-"), "featherloom.zip")   # Spark sends it on to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("featherloom", os.path.relpath(os.path.join(folder, f), home)))
    context.addPyFile(path)
    _SHIPPED[context.applicationId] = path
