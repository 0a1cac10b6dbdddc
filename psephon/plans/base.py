"""Registration of queries, and the roles that the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB counterpart."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``; adding zero turns a negative zero into zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: race, contestant, date, value, days to the end, size and grade, unique id."""
    e = load(spark, sf_dir, "events")
    k = F.from_json("props", "k int").getField("k")
    return e.select(
        F.col("user_id").alias("race"), F.col("event_type").alias("cand"), F.col("ts").cast("date").alias("d"), F.col("value").alias("pct"),
        F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")).alias("days"), k.alias("size"), (k % 4).alias("grade"), "event_id",
    )


READINGS = """readings AS (SELECT user_id AS race, event_type AS cand, ts::DATE AS d, value AS pct, CAST(date_diff('day', ts::DATE, DATE '2024-01-31') AS INTEGER) AS days,
  CAST(json_extract(props, '$.k') AS INTEGER) AS size, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS grade, event_id FROM events)"""


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as party readings: race, party, year, poll month, house, value."""
    li = load(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    party = F.when(F.col("l_returnflag") == "A", "DEM").when(F.col("l_returnflag") == "R", "REP").otherwise("OTH")
    return li.select(F.col("l_suppkey").alias("race"), party.alias("party"), F.year(d).alias("year"), F.trunc(d, "MM").alias("poll"), F.month(d).alias("house"), F.col("l_quantity").alias("pct"))


BALLOTS = """ballots AS (SELECT l_suppkey AS race, CASE l_returnflag WHEN 'A' THEN 'DEM' WHEN 'R' THEN 'REP' ELSE 'OTH' END AS party, CAST(year(l_shipdate) AS INTEGER) AS year,
  date_trunc('month', l_shipdate)::DATE AS poll, CAST(month(l_shipdate) AS INTEGER) AS house, l_quantity AS pct FROM lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in (0, 1) from their length."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    p = F.col("n_chars") / (F.col("n_chars") + F.lit(1500.0))
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), F.round(p, 6).alias("p"))


SCORED = "scored AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, round(d.n_chars / (d.n_chars + 1500.0::DOUBLE), 6) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
