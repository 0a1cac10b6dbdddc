"""Evaluation of scores against outcomes, exact and without any global sort on one task.

``placed`` gives every distinct score the number of rows below it. Distinct scores are cut into ranges of about equal
numbers of them; the few range totals are added up in order, and rows are ordered only within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephon.operators.aggregates import two_parties

RANGES, CLIP = 1024, 1e-15


def placed(df: DataFrame, groups: list[str], score: str, measures: dict[str, Column]) -> DataFrame:
    """Per (groups, distinct score): the summed measures, and ``below_<measure>``, their sums over lower scores."""
    found = df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(*[F.sum(m).alias(k) for k, m in measures.items()])
    # Edges may be approximate: any cut gives the same sums, and equal scores are one row, so no range is much larger.
    edges = found.groupBy(*groups).agg(F.percentile_approx(F.col(score).cast("double"), [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("__e"))
    found = found.join(F.broadcast(edges), groups) if groups else found.crossJoin(F.broadcast(edges))  # a row for each group of a report
    halving = F.array(*[F.lit(1 << k) for k in range(RANGES.bit_length() - 2, -1, -1)])
    found = found.withColumn("__r", F.aggregate(halving, F.lit(0), lambda at, step: F.when(F.element_at("__e", at + step) < F.col(score), at + step).otherwise(at))).drop("__e")
    totals = found.groupBy(*groups, "__r").agg(*[F.sum(k).alias(f"__t_{k}") for k in measures])
    before = Window.partitionBy(*groups).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__r", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in measures])
    inside = Window.partitionBy(*groups, "__r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    joined = found.join(F.broadcast(offsets), [*groups, "__r"])  # RANGES rows for each group at most
    return joined.select(*groups, score, *measures, *[(F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"__o_{k}")).alias(f"below_{k}") for k in measures])


def auc(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties at one half; null if a class is missing."""
    y = F.col(label)
    rows = placed(df, groups, score, {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")})
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") * F.lit(0.5)))
    return rows.groupBy(*groups).agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def losses(label: str, score: str) -> list[Column]:
    """Brier score, log-loss (clipped) and accuracy at one half."""
    y, p = F.col(label).cast("double"), F.col(score)
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return [F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"), F.avg(((p > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy")]


def metrics(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    rest = df.groupBy(*groups).agg(F.count("*").alias("n"), *losses(label, score))
    area = auc(df, groups, label, score)
    return rest.join(area, groups) if groups else rest.crossJoin(F.broadcast(area))  # one row each


def quantiles(df: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """(k, edge): exact quantiles by linear interpolation."""
    rows = placed(df, [], score, {"n": F.lit(1)})
    total = rows.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.createDataFrame([(i, s, side) for i, s in enumerate(shares) for side in (0, 1)], "k int, share double, side int")
    wanted = wanted.crossJoin(F.broadcast(total)).withColumn("at", (F.col("total") - 1) * F.col("share")).withColumn("place", F.least(F.floor("at") + F.col("side"), F.col("total") - 1))
    hit = rows.join(F.broadcast(wanted), (F.col("below_n") <= F.col("place")) & (F.col("place") < F.col("below_n") + F.col("n")))
    low, high = F.max(F.when(F.col("side") == 0, F.col(score))), F.max(F.when(F.col("side") == 1, F.col(score)))
    return hit.groupBy("k").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("edge"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 8) -> DataFrame:
    """Mean score and observed rate by quantile bin; a score's bin is the number of inner edges below it."""
    edges = quantiles(df, score, [k / bins for k in range(1, bins)]).agg(F.collect_list("edge").alias("edges"))  # bins - 1 values
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(score))))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    cells = [F.count_if((F.col(label) == y) & (F.col(predicted) == p)).alias(name) for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return df.agg(*cells)


def blends(df: DataFrame, first: str, second: str, name: str, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The table once for each alpha (a fixed few), with alpha * first + (1 - alpha) * second."""
    each = df.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    return each.withColumn(name, F.col("alpha") * F.col(first) + (F.lit(1.0) - F.col("alpha")) * F.col(second))


def house_effects_by_fold(df: DataFrame, period: str, periods: list[int], race: str, poll: str, house: str, party: str, value: str, name: str = "fold") -> DataFrame:
    """(fold, house, house_effect) of each leave-one-period-out fold: margins are taken and summed once, then dealt to folds.

    What is copied for each fold is one row for each (period, race, house). ``poll`` belongs to one period.
    """
    margin = F.col("DEM") - F.col("REP")
    cells = two_parties(df, [period, race, poll, house], party, value).groupBy(period, race, house).agg(F.sum(margin).alias("s"), F.count(margin).alias("n"))
    cells = folds(cells, period, periods, name)
    means = cells.groupBy(name, race).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    off = F.sum(F.when(F.col("n") > 0, F.col("s") - F.col("n") * F.col("mean")))
    return cells.join(means, [name, race]).groupBy(name, house).agg(F.try_divide(off, F.sum("n")).alias("house_effect"))


def folds(df: DataFrame, period: str, periods: list[int], name: str = "fold") -> DataFrame:
    """Training rows of each leave-one-period-out fold: all rows of other periods. Periods are a short, given list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(p) for p in periods]))).filter(F.col(name) != F.col(period))
