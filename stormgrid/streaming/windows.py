"""Streaming forms of hourly totals and wet spells: additions, the reference has no streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Totals by tumbling (or sliding) window, for a stream or a table; later rows than `late` are dropped from a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), "total", "n")


def spells(events: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", gap: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Spells that end when nothing has come for `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "total", "n")
