"""Structured Streaming forms: event logs, windows, sessions, index upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of event files. Watermarks need ``ts`` as an instant; a time
    without a zone is taken in the session's."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and time window; the watermark bounds state."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream as JSON, partitioned by UTC day."""
    dated = events.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    return dated.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def latest_snapshot(versions: DataFrame) -> DataFrame:
    """The last content hash of each path from versions (path, content_sha, ts)."""
    return versions.groupBy("path").agg(F.max_by("content_sha", "ts").alias("content_sha"))


def maintain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs an idempotent update for each micro-batch of changed files."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
