"""Streaming counts of items, beyond what the batch queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per item and window of event time; rows later than the watermark are left
    out. events has ts (a timestamp) and item_id."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "item_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "item_id", "n")
