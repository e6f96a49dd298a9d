"""Streams of recognized words: windowed counts with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in each window; works on a stream and on a table alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
