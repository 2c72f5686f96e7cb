"""Event counts and sums by time window, for streams and for stored tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total: tumbling windows of event time.

    On a stream the watermark closes a window once events later than `late`
    cannot come any more, which bounds the state; on a table it has no effect.
    """
    rows = events.where("ts is not null")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """One row per key and delivery time, repeated deliveries of a stream dropped within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at])
