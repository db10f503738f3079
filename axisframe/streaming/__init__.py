"""Time-windowed aggregation of unbounded cells (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resample_stream(cells: DataFrame, time: str, width: str, value: str, keys: list[str] | None = None, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Sum, mean, count and extrema of a stream's cells by event-time window.

    ``late`` bounds the state: windows are final once the watermark passes, and
    cells that come later are left out. Works on static tables alike.
    """
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    source = cells.withWatermark(time, late) if cells.isStreaming else cells
    v = F.col(value)
    out = source.groupBy(window.alias("w"), *(keys or [])).agg(
        F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "sum", "mean", "min", "max", "count")
