"""Streaming forms: session windows with watermarks over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions that a silence of ``gap`` ends; events
    later than the watermark ``late`` are dropped.  Unlike coalescing in batch,
    a gap of exactly ``gap`` separates, and other speakers do not block."""
    w = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, key: str, at: str, length: str, slide: str, late: str) -> DataFrame:
    """(key, start, end, n) of sliding windows."""
    w = F.window(at, length, slide)
    out = events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
