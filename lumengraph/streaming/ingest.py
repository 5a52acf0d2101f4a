"""Incremental document ingest as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import chunk_rows
from ..functions.cleaning import clean


def document_stream(spark: SparkSession, path: str, schema, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """New Parquet files of a folder, each doc_id once; with an event time, state older than ``late`` is dropped."""
    rows = spark.readStream.schema(schema).parquet(path)
    if event_time:
        return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["doc_id"])
    return rows.dropDuplicates(["doc_id"])


def chunk_stream(documents: DataFrame) -> DataFrame:
    return chunk_rows(documents.withColumn("text", clean(F.col("text"))))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new since the checkpoint, then stops."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
