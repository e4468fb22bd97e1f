"""Counts of categories over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, category: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by category in tumbling windows; with a streaming frame, rows later than ``late`` are dropped.

    The state is a count for each open window and category.
    """
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = events.groupBy(F.window(time, width), category).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), category, "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as far as repeats come within ``late``."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
