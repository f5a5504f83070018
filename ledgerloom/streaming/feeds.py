"""Structured Streaming over feeds of events: windows with watermarks, sessions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "2 days"


def stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """A file stream with the schema of what lies at ``path`` now; ``ts`` becomes an event time."""
    schema = spark.read.parquet(f"{path}/{pattern}" if pattern else path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly(events: DataFrame) -> DataFrame:
    """Counts and sums by week (from Monday) and type. On a stream, later events than ``DELAY`` are dropped."""
    kept = events.withWatermark("ts", DELAY) if events.isStreaming else events
    week = F.window("ts", "7 days", startTime="4 days")
    sums = kept.groupBy(week, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return sums.select(F.col("window.start").cast("date").alias("week"), "event_type", "n", "cents")


def sliding(events: DataFrame, span: str = "30 days", step: str = "1 day") -> DataFrame:
    kept = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return kept.groupBy(F.window("ts", span, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    kept = events.withWatermark("ts", DELAY) if events.isStreaming else events
    rows = kept.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp").alias("start"), "n")


def without_duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each key within the watermark (on a stream) or at all (in a batch)."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def collected(frame: DataFrame, checkpoint: str, out: str, mode: str = "append"):
    """Run what is there now to Parquet and end: ``availableNow``."""
    return frame.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start()
