"""Windows over event streams; the same functions run on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(begin, event_type, n, total) by tumbling or sliding windows; ``late`` sets a watermark."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def session_counts(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("begin"), "n")
