"""Streaming forms: windowed counts over an event stream, and arriving chunks deduplicated under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per type and window; works on a batch and, under a watermark, on a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def first_deliveries(chunks: DataFrame, late: str = "7 days") -> DataFrame:
    """Chunks without repeated deliveries of one key and time of update."""
    keys = ["book_id", "chapter_index", "chunk_index", "updated_at"]
    if chunks.isStreaming:
        return chunks.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(keys)
    return chunks.dropDuplicates(keys)
