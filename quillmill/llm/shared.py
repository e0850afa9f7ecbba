"""Helpers of several operators: the shared folder, tokenizer files, batches inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import hand_back, settled, shared_folder, small_batches  # noqa: F401


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: df written to the shared folder and read again: lineage is cut and a lost executor costs nothing.
settle = settled


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again; what was made of it must be settled."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, rows: int = 256) -> Iterator:
    """Row ranges of an Arrow batch, so that what a task builds per row stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
