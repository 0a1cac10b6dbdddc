"""Long monthly series (date, metric, value): resampling, gap filling, change over a year, figures for a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephon.operators.aggregates import slope


def monthly(df: DataFrame, date: str, keys: list[str], value: str, gaps: bool = False) -> DataFrame:
    """Mean of each month that has values, dated by its first day; with ``gaps``, null for months between that have none."""
    found = df.groupBy(F.trunc(date, "MM").alias("month"), *keys).agg(F.avg(value).alias(value))
    if not gaps:
        return found
    months = F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))
    return found.groupBy(*keys).agg(months.alias("month")).withColumn("month", F.explode("month")).join(found, [*keys, "month"], "left")


def calendar_filled(df: DataFrame, date: str, keys: list[str], value: str, step: str = "1 day") -> DataFrame:
    """A row for each step between the first and last date of the table, values carried forward; ``filled`` marks gaps."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))  # one row
    spine = df.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(date))
    joined = spine.join(df.select(*keys, date, value), [*keys, date], "left")
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*keys, date, F.last(value, True).over(w).alias(value), F.col(value).isNull().alias("filled"))


def change_over(date: str, keys: list[str], value: str, rows: int = 12) -> Column:
    """Percent change against ``rows`` rows earlier in the series (rows, not months)."""
    w = Window.partitionBy(*keys).orderBy(date)
    return (F.try_divide(F.col(value), F.lag(value, rows).over(w)) - 1) * 100


def cycle_rows(df: DataFrame, cycles: DataFrame, date: str, metric: str, value: str) -> DataFrame:
    """Values of each cycle's window (start, eve], with places from the front (0 on) and from the back (1 on).

    ``cycles`` (cycle, start, eve) is a literal relation of a few rows.
    """
    inside = df.filter(F.col(value).isNotNull()).join(F.broadcast(cycles), (F.col(date) > F.col("start")) & (F.col(date) <= F.col("eve")))
    w = Window.partitionBy("cycle", metric)
    return inside.withColumn("i", F.row_number().over(w.orderBy(date)) - 1).withColumn("back", F.row_number().over(w.orderBy(F.col(date).desc())))


def cycle_stats(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """eve, mean, max, min, std (population), trend over the places, and the last value less the one 12 before."""
    v, at = F.col(value), F.col("i").cast("double")
    nth = lambda k: F.max(F.when(F.col("back") == k, v))
    return rows.groupBy("cycle", metric).agg(
        nth(1).alias("eve"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"),
        slope(v, at, default=0.0).alias("trend"), F.coalesce(nth(1) - nth(13), F.lit(0.0)).alias("last12_delta"),
    )


def recency_stats(rows: DataFrame, metric: str, value: str, cuts: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Mean, maximum and trend over the last values."""
    v, at, out = F.col(value), F.col("i").cast("double"), []
    for n in cuts:
        late = F.col("back") <= n
        out += [F.avg(F.when(late, v)).alias(f"avg_{n}mo"), F.max(F.when(late, v)).alias(f"max_{n}mo"), slope(v, at, late, default=0.0).alias(f"trend_{n}mo")]
    return rows.groupBy("cycle", metric).agg(*out)


def widened(stats: DataFrame, metric: str, metrics: list[str], names: list[str]) -> DataFrame:
    """One row for each cycle, a column for each metric and figure; the list of metrics is given, not looked up."""
    aggs = [F.max(F.when(F.col(metric) == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in names]
    return stats.groupBy("cycle").agg(*aggs)
