"""Extension: windowed counts over event streams. The batch queries run the same transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of parquet files, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Count and sum of each kind in tumbling or sliding windows."""
    rows = events.withWatermark(time, lateness) if lateness else events
    out = rows.groupBy(F.window(time, width, slide), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n", "total")


def sessions(events: DataFrame, user: str, time: str, gap: str, lateness: str | None = None) -> DataFrame:
    """Sessions of users: start, end, events."""
    rows = events.withWatermark(time, lateness) if lateness else events
    out = rows.groupBy(user, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
