"""Ordered events of a key: lockouts, sessions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locked_attempts(attempts: DataFrame, by: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Adds ``failures_before`` (earlier failed attempts of the key) and ``locked`` (``most`` or more of them)."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = attempts.withColumn("failures_before", F.coalesce(F.count_if(failed).over(before), F.lit(0)))
    return out.withColumn("locked", F.col("failures_before") >= most)


def sessions(events: DataFrame, by: str, ts: str, order: list[str], gap_s: int) -> DataFrame:
    """Adds ``session``, counted from 1 in each key: a new one begins ``gap_s`` seconds or more after the last event."""
    own = Window.partitionBy(by).orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    begins = F.when(at - F.lag(at).over(own) < gap_s * 1_000_000, 0).otherwise(1)
    return events.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")
