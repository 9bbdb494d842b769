"""Pair counts kept up to date over a stream of reports: sums of partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Count and sum of ``value`` by keys so far; for output mode ``complete`` or ``update``."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time; rows later than ``late`` are dropped once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
