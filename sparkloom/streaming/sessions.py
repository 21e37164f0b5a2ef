"""Windows over streams: event time with watermarks; state is bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, late: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates per window of `size` and key; rows later than `late` are dropped."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(*aggregates)


def sliding(df: DataFrame, ts: str, size: str, slide: str, late: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(*aggregates)


def sessions(df: DataFrame, ts: str, gap: str, late: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Sessions of each key, closed when the watermark is past their gap."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(*aggregates)


def deduplicated(df: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
