"""Grouped aggregates over event-time windows, for frames and streams alike (an extension: sheets have no streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, late: str | None, keys: list[str], **aggregates: Column) -> DataFrame:
    """``keys, window_start`` and the aggregates; ``late`` is the watermark of a stream."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = df.groupBy(F.window(time, width).alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(*keys, F.col("__w.start").alias("window_start"), *aggregates)
