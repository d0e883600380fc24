"""Structured Streaming forms of the sliding sector signal (an extension; the reference has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.columns import safe_div


def stream_sector_signal(pit: DataFrame, timestamp: str = "ts", window: str = "30 days", every: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Per sector and sliding window: weighted sentiment, weight and number of observations. Late rows are accepted up to the
    watermark; the state holds one row per sector and open window."""
    total = F.sum("weight")
    grouped = pit.withWatermark(timestamp, lateness).groupBy(F.window(timestamp, window, every), "sectorId")
    rows = grouped.agg(safe_div(F.sum("weighted_sentiment"), total).alias("sector_sentiment"), total.alias("weight_coverage"), F.count("sentiment").alias("n_docs"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "sectorId", "sector_sentiment", "weight_coverage", "n_docs")
