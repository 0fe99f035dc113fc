"""Windowed counts and sums of event tables, for batches and streams alike (additions).

Late rows are bounded by a watermark where the input is a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def _summed(events: DataFrame, window: Column, by: Sequence[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, size: str, by: Sequence[str] = (), time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    return _summed(_watermarked(events, time, late), F.window(time, size), by, value)


def sliding(events: DataFrame, size: str, step: str, by: Sequence[str] = (), time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    return _summed(_watermarked(events, time, late), F.window(time, size, step), by, value)


def sessions(events: DataFrame, gap: str, by: Sequence[str], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    return _summed(_watermarked(events, time, late), F.session_window(time, gap), by, value)


def first_seen(events: DataFrame, keys: Sequence[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key's rows but for repeats; a stream forgets keys behind the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))
