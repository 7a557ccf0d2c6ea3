"""Structured Streaming over an event table: windowed activity, sessions, exact-once events.

The operators take a streaming or a batch DataFrame with ``ts``; batch results
over the same rows are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and values by type in tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total_value"), F.approx_count_distinct("user_id").alias("users"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total_value", "users")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, though it may be delivered again within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Process what is there and stop: for tests and catch-up runs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
