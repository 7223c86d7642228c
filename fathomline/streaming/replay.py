"""Incremental replay of append-only action logs with Structured Streaming. An extension: the log's batch form is in plans.stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(log: DataFrame, keys: list[str], at: str, value: str, late: str = "1 day") -> DataFrame:
    """The last value of each key within each day of event time. Rows later than the watermark are dropped, so state stays bounded."""
    day = F.window(at, "1 day")
    latest = log.withWatermark(at, late).groupBy(day.alias("day"), *keys).agg(F.max(F.struct(at, value)).alias("m"), F.count(F.lit(1)).alias("actions"))
    return latest.select(F.col("day.start").alias("day"), *keys, f"m.{value}", "actions")
