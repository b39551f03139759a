"""Event-time windows over a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list, late: str | None = None) -> DataFrame:
    return sliding(df, ts, size, size, keys, aggs, late)


def sliding(df: DataFrame, ts: str, size: str, step: str, keys: list[str], aggs: list, late: str | None = None) -> DataFrame:
    """late: how long a stream waits for late rows."""
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.window(ts, size, step), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])
