"""Windowed counts over a stream of events, with a watermark. The reference has none; this is an extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, by: list[str], values: dict[str, Column], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates of tumbling windows (sliding, with `slide`); on a stream, `late` is the watermark's delay."""
    rows = events.withWatermark(time, late) if late else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("w"), *by).agg(*(c.alias(n) for n, c in values.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *values)


def sessions(events: DataFrame, time: str, by: list[str], values: dict[str, Column], gap: str, late: str | None = None) -> DataFrame:
    """Aggregates of sessions: events of one `by` with less than `gap` between neighbours."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*(c.alias(n) for n, c in values.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *values)
