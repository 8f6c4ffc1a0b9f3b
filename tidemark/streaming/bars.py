"""An extension: hourly bars of a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """events: event_id, ts, event_type, value; streaming or not. A bar is final when the watermark passes its hour."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")
