"""Aggregates: weighted means with fallbacks, slopes, first and last by date, party pivots, house effects, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight. A null weight is 0, a null value the group's mean; without any weight, the plain mean."""
    w = F.coalesce(weight, F.lit(0.0))
    plain = F.avg(value)
    total = F.sum(w)
    known = F.coalesce(F.sum(F.when(value.isNotNull(), value * w)), F.lit(0.0))
    unknown = F.coalesce(F.sum(F.when(value.isNull(), w)), F.lit(0.0))
    return F.when((total > 0) & (F.count(value) > 0), (known + plain * unknown) / total).otherwise(plain)


def recent_mean(value: Column, days: Column, within: int = 30) -> Column:
    """Mean over rows of the last days; over all rows if there are none."""
    recent = F.coalesce(days <= within, F.lit(False))
    return F.when(F.count_if(recent) > 0, F.avg(F.when(recent, value))).otherwise(F.avg(value))


def slope(y: Column, x: Column, where: Column | None = None, least: int = 2, default: float | None = None) -> Column:
    """Least-squares slope; ``default`` below ``least`` points or where x is constant."""
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    yy, xx = F.when(ok, y), F.when(ok, x)
    both = F.when(y.isNotNull() & x.isNotNull() & ok, 1)
    out = F.when((F.count(both) >= least) & (F.min(xx) < F.max(xx)), F.regr_slope(yy, xx))
    return out if default is None else F.coalesce(out, F.lit(default))


def by_date(value: Column, date: Column, *ties: Column, last: bool) -> Column:
    """Value of the first or last row by date; rows without a date come after all others."""
    key = F.struct(date.isNull().alias("undated"), date.alias("date"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    return F.max_by(value, key) if last else F.min_by(value, key)


def two_parties(df: DataFrame, keys: list[str], party: str, value: str, plus: str = "DEM", minus: str = "REP") -> DataFrame:
    """A row for each key with the greatest value of either party; both columns always exist."""
    sides = [F.max(F.when(F.col(party) == p, F.col(value))).alias(p) for p in (plus, minus)]
    return df.filter(F.col(party).isin(plus, minus)).groupBy(*keys).agg(*sides)


def house_effect(df: DataFrame, race: str, poll: str, house: str, party: str, value: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per house (and ``extra``, such as a fold): mean deviation of its two-party margins from the race's mean margin.

    A house with no margin at all keeps a row with null.
    """
    polls = two_parties(df, [*extra, race, poll, house], party, value).withColumn("m", F.col("DEM") - F.col("REP"))
    means = polls.groupBy(*extra, race).agg(F.avg("m").alias("mean_m"))
    return polls.join(means, [*extra, race]).groupBy(*extra, house).agg(F.avg(F.col("m") - F.col("mean_m")).alias("house_effect"))


def missingness(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, pct_missing) of every column, in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', `__{i}`" for i, c in enumerate(df.columns))
    long = counts.select("__n", F.expr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_missing)"))
    return long.select("column_name", "n_missing", F.try_divide(F.col("n_missing") * 100.0, F.col("__n")).alias("pct_missing"))


def profile(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Rows and, for each value, least, greatest and how many are known, per group."""
    aggs = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("min", F.min), ("max", F.max), ("known", F.count))]
    return df.groupBy(group).agg(F.count("*").alias("n"), *aggs)
