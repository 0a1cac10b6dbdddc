"""Unions, dedupes, joins and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast by hand only where Spark's own estimate of it is under this many bytes.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is known to be small; otherwise the optimizer decides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key (null equals null): the least by ``order``, which has to be total.

    An aggregate, not a window: it combines on the map side, so a key with many rows is no hot partition.
    """
    present = [k for k in keys if k in df.columns]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*present).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def last_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key: the greatest by ``order``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def with_match(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join to a side that is unique by ``keys``, with 1 or 0 for whether it matched."""
    joined = left.join(right.withColumn("__m", F.lit(1)), keys, "left")
    return joined.withColumn(flag, F.coalesce("__m", F.lit(0))).drop("__m")


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], value: str, unknown: Column | None = None) -> DataFrame:
    """Attach ``value`` from a dimension unique by ``keys``. An unknown key gets ``unknown``; a known null stays null."""
    joined = df.join(small(dim.select(*keys, value, F.lit(True).alias("__known"))), keys, "left")
    if unknown is not None:
        joined = joined.withColumn(value, F.when(F.col("__known").isNull(), unknown).otherwise(F.col(value)))
    return joined.drop("__known")


def latest_before(probe: DataFrame, history: DataFrame, keys: list[str], year: str, value: str, steps: tuple[int, ...] = (2, 4, 6, 8)) -> DataFrame:
    """Bounded as-of: the value of the nearest year that is one of ``steps`` earlier and not null, else null.

    History rows are copied once for each step (a fixed few) onto the year that they serve, which makes this an
    equi-join after a map-side aggregate instead of a range join.
    """
    served = history.filter(F.col(value).isNotNull()).select(*keys, F.explode(F.array(*[F.lit(s) for s in steps])).alias("__step"), F.col(year).alias("__from"), F.col(value))
    served = served.withColumn(year, (F.col("__from") + F.col("__step")).cast(probe.schema[year].dataType))
    nearest = served.groupBy(*keys, year).agg(F.max_by(value, "__from").alias(value))
    return probe.join(nearest, [*keys, year], "left")


def matching(df: DataFrame, other: DataFrame, keys: list[str], has: bool = True) -> DataFrame:
    """Rows with (or without) a partner."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi" if has else "left_anti")


def containing(df: DataFrame, column: str, word: str) -> DataFrame:
    """Rows whose text has ``word``, whatever its case; null has not. Without such a column, all rows."""
    found = pick(df.columns, column)
    return df.filter(F.coalesce(F.lower(F.col(f"`{found}`").cast("string")).contains(word), F.lit(False))) if found else df


def peek(df: DataFrame, n: int = 3) -> tuple[list[str], DataFrame]:
    """The columns, and the first rows."""
    return df.columns, df.limit(n)


def pick(columns: list[str], *names: str) -> str | None:
    """First of ``names`` that is a column, whatever its case."""
    by_lower: dict[str, str] = {}
    for c in columns:
        by_lower.setdefault(c.lower(), c)
    return next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)


def resolved(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame | None:
    """Logical columns by the first alias that is there, missing ones null; None if a required one is missing."""
    found = {logical: pick(df.columns, *names) for logical, names in aliases.items()}
    if any(found[r] is None for r in required):
        return None
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(logical) for logical, c in found.items()])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to a fixed schema; what does not fit becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])
