"""Stream form of the sliding-window summary; it shares the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(events: DataFrame, width: str = "4 hours", step: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Count, mean and spread per event type and sliding window; works on batch and streaming tables alike."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy("event_type", F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd_value")
    )
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "mean_value", "sd_value")
