"""Structured Streaming forms of the period counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, timestamp: str, keys: list[str], width: str = "1 day", slide: str | None = None,
                    late: str = "1 day") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped.

    The same expression runs on a static frame, where the watermark has no effect.
    """
    window = F.window(timestamp, width, slide) if slide else F.window(timestamp, width)
    out = rows.withWatermark(timestamp, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def start_windowed_counts(rows: DataFrame, timestamp: str, keys: list[str], path: str, checkpoint: str, **kw):
    """Append closed windows to Parquet, exactly once through the checkpoint."""
    out = windowed_counts(rows, timestamp, keys, **kw)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
