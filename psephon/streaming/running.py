"""Running means over a stream of readings: an extra beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(readings: DataFrame, time: str, keys: list[str], value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean and count per key and time window; rows later than ``late`` are dropped, and state with them."""
    by = readings.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys)
    return by.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), *keys, "mean", "n")
