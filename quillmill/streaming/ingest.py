"""Incremental ingestion, an extension: new parsed documents become index chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import index


def ingest(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet files of documents (doc_id, text, and user_id and thread_id where there are some) as they appear under source into an index.

    A document that comes again replaces what the index has of it. Each micro-batch is a segment with its chunks, postings and changes of the statistics, so that the index is searched as one that is
    built anew. The index remembers the last batch of this checkpoint: one that is run again is not taken in twice."""

    def upsert(batch: DataFrame, number: int) -> None:
        index.put(batch.sparkSession, path, index.parsed_chunks(batch), replaces=[*index.OWNER, "document_id"], mark=(checkpoint, number))

    docs = spark.readStream.schema(schema).parquet(source)
    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by tumbling window and kind; works on a stream as on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
