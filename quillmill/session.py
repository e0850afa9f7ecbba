"""One place that builds the Spark session for tests, benchmarks and scripts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the engine relies on; on a cluster use the cluster's own."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("quillmill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILLMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_spread(spark: SparkSession, path: str, most: int = 32) -> DataFrame:
    """A Parquet table; one in so few pieces that most cores would stand idle is dealt out first.

    Larger tables are left as they are read."""
    df = spark.read.parquet(path)
    cores = min(most, spark.sparkContext.defaultParallelism)
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; on one machine a local one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: what several steps need is computed once, and a lost executor costs a task."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Plans that are carried out inside hand rows to Python by up to ``rows``, so that a task and its Python process hold less at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def hand_back() -> None:
    """At a task's end: free memory goes from its Python process to the system, as that process lives on through the stages behind it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
