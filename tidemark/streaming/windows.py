"""Event-time windows over a stream of observations; an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, at: str, width: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    """Count, sum and newest time for each tumbling window and key; rows later than `lateness` fall out.

    State is kept until the watermark passes a window, so it is bounded by the lateness. Without one
    the stream's own watermark holds.
    """
    rows = (stream if lateness is None else stream.withWatermark(at, lateness)).groupBy(F.window(at, width), *keys)
    found = rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(at).alias("newest"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "newest")


def without_repeats(stream: DataFrame, at: str, lateness: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the lateness: replays of a page add nothing."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
