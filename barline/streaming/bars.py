"""Bars from a stream of ticks, by event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, *, symbol: Column, price: Column, time: str = "ts", order: Column | None = None, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(symbol, timestamp, open, high, low, close, volume) of each window.

    The same expressions serve a batch table and a stream; on a stream a window is final when the
    watermark passes its end, and later ticks are dropped.
    """
    at = F.col(time).cast("timestamp")
    key = F.struct(at, order) if order is not None else at
    t = ticks.select(symbol.alias("symbol"), at.alias("__at"), price.alias("p"), key.alias("o"))
    if ticks.isStreaming:
        t = t.withWatermark("__at", late)
    cells = t.groupBy("symbol", F.window("__at", width).alias("w"))
    bars = cells.agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
