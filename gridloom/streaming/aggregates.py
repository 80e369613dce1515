"""The Column functions on streams: windowed reductions with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def windowed(stream: DataFrame, time: str, length: str, aggregates: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Reductions in tumbling or sliding windows of event time; rows later than ``late`` are dropped."""
    frame = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = out.groupBy(frame.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "0 seconds") -> DataFrame:
    """Reductions over sessions: runs of events less than ``gap`` apart."""
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = out.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(c for c in out.columns if c != "w"))
