"""Windowed aggregates over events, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, by: str, value: str) -> DataFrame:
    """Counts and sums for each window and group, with the window's first day."""
    at = F.window(F.col(ts).cast("timestamp"), size)
    return events.groupBy(at.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), by, "n", "total")


def tumbling_stream(events: DataFrame, ts: str, size: str, late: str, by: str) -> DataFrame:
    """Counts for each window and group; a window is final once the watermark has passed it."""
    some = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return some.groupBy(F.window("at", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_stream(events: DataFrame, ts: str, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of a group: events less than ``gap`` apart."""
    some = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return some.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_deliveries(events: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """A stream without repeated deliveries that come within ``late`` of the first."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(key)
