"""Computations relative to a race (a group of contestants), over time or not.

Race windows partition a table that has been aggregated to (race, contestant) or (race, day, contestant), so a
partition has as many rows as a race has contestants (and days), however many readings there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_second_largest(df: DataFrame, race: str, value: str, name: str) -> DataFrame:
    """Adds the second-largest value of the race (equal values count apiece; nulls do not); the largest if it stands alone."""
    w = Window.partitionBy(race)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(F.col(value).desc_nulls_last())))
    second = F.max(F.when(F.col("__rn") == 2, F.col(value))).over(w)
    return ranked.withColumn(name, F.coalesce(second, F.max(value).over(w))).drop("__rn")


def lead(df: DataFrame, race: str, value: str) -> DataFrame:
    """Lead over the race's second-largest value, share of its sum, what is left to 100, and contestants."""
    w = Window.partitionBy(race)
    best = with_second_largest(df, race, value, "field_best")
    total = F.sum(value).over(w)
    return best.select("*", (F.col(value) - F.col("field_best")).alias("lead"), F.try_divide(F.col(value), total).alias("share"), (F.lit(100.0) - total).alias("undecided"), F.count(F.lit(1)).over(w).alias("n_cands"))


def softmax(value: str, race: str, temperature: float = 3.0) -> Column:
    """Softmax within the race; a null value counts as the race's mean."""
    w = Window.partitionBy(race)
    filled = F.coalesce(F.col(value), F.avg(value).over(w))
    e = F.exp((filled - F.max(value).over(w)) / temperature)
    return e / F.sum(e).over(w)


def winners(df: DataFrame, groups: list[str], score: str, tie: str) -> DataFrame:
    """The row of greatest score in each group, the least ``tie`` among equals."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def running_means(df: DataFrame, race: str, cand: str, date: str, value: str) -> DataFrame:
    """(race, date, cand, m): each contestant's mean of all readings up to each date on which the race had any.

    Readings are summed by day first, so the spine has days times contestants rows. A contestant joins on the day
    of the first reading and is carried forward. Means are rounded to 9 places, so that equal means compare equal.
    """
    daily = df.filter(F.col(date).isNotNull() & F.col(value).isNotNull() & F.col(race).isNotNull() & F.col(cand).isNotNull()).groupBy(race, cand, date).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    dates, cands = daily.select(race, date).distinct(), daily.select(race, cand).distinct()
    spine = dates.join(cands, race).join(daily, [race, cand, date], "left")
    w = Window.partitionBy(race, cand).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    summed = spine.select(race, cand, date, F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    return summed.filter("n > 0").select(race, date, cand, F.round(F.col("s") / F.col("n"), 9).alias("m"))


def lead_changes(means: DataFrame, race: str, cand: str, date: str) -> DataFrame:
    """(race, n_lead_changes): days on which another contestant leads than on the race's day before."""
    leaders = winners(means, [race, date], "m", cand)
    w = Window.partitionBy(race).orderBy(date)
    changed = leaders.withColumn("changed", F.coalesce((F.lag(cand).over(w) != F.col(cand)).cast("int"), F.lit(0)))
    return changed.groupBy(race).agg(F.sum("changed").alias("n_lead_changes"))


def margins(means: DataFrame, race: str, cand: str, date: str) -> DataFrame:
    """Adds each day's margin over the best other contestant (0 if there is none yet) and days since the race began."""
    day = Window.partitionBy(race, date).orderBy(F.col("m").desc(), F.col(cand))
    whole = Window.partitionBy(race, date)
    ranked = means.withColumn("rn", F.row_number().over(day))
    best, second = F.max(F.when(F.col("rn") == 1, F.col("m"))).over(whole), F.max(F.when(F.col("rn") == 2, F.col("m"))).over(whole)
    other = F.when(F.col("rn") == 1, second).otherwise(best)
    begun = F.min(date).over(Window.partitionBy(race))
    return ranked.select(race, date, cand, "m", F.when(F.count(F.lit(1)).over(whole) == 1, F.lit(0.0)).otherwise(F.col("m") - other).alias("margin"), F.datediff(date, begun).alias("elapsed"))


def margin_trajectory(df: DataFrame, race: str, cand: str, date: str, value: str) -> DataFrame:
    """Mean, volatility, minimum and trend of each contestant's margin over time."""
    from psephon.operators.aggregates import slope

    rows = margins(running_means(df, race, cand, date, value), race, cand, date)
    return rows.groupBy(race, cand).agg(
        F.avg("margin").alias("avg_margin"), F.stddev_pop("margin").alias("margin_volatility"), F.min("margin").alias("min_margin"),
        slope(F.col("margin"), F.col("elapsed").cast("double"), default=0.0).alias("margin_trend"),
    )


def ranked(df: DataFrame, value: str, tie: str, n: int, name: str = "rank") -> DataFrame:
    """The ``n`` rows of greatest value, with their ranks: a top-k, then a window over those rows alone."""
    top = df.orderBy(F.col(value).desc(), F.col(tie)).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(tie))))
