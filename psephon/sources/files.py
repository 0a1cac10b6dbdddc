"""Readers and writers: delimited text as text columns, nested series payloads, literal relations."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What delimited files write for nothing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
PAYLOAD = T.StructType([T.StructField("series", T.StructType([T.StructField("docs", T.ArrayType(T.StructType([T.StructField("period", T.ArrayType(T.StringType())), T.StructField("value", T.ArrayType(T.StringType()))])))]))])
MARKUP = ("<!doctype", "<html", "<")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one checkpoints are set to, or named in ``spark.checkpoint.dir``.

    Where neither is, a temporary folder will do on a single machine; on a cluster that is an error.
    """
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not set_already.isEmpty():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="psephon-")


def read_text_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with a header, every column text (no inference pass), missing marks as null."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(paths)
    return raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def write_text_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, metric) from a long CSV."""
    return spark.read.option("header", True).schema("date date, value double, metric string").csv(path)


def looks_like_markup(text: str) -> bool:
    """Whether a download that should be data is a web page."""
    return text.lstrip().lower().startswith(MARKUP)


def payload_rows(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """(keep..., period, value) of the first series of each JSON payload; values that are no numbers are dropped."""
    parsed = df.select(*keep, F.from_json(body, PAYLOAD).alias("p"))
    first = parsed.select(*keep, F.try_element_at(F.col("p.series.docs"), F.lit(1)).alias("d"))
    rows = first.select(*keep, F.inline(F.arrays_zip(F.col("d.period").alias("period"), F.col("d.value").alias("value"))))
    return rows.withColumn("value", F.col("value").try_cast("double")).filter("value IS NOT NULL")


def period_start(period: Column) -> Column:
    """First day of a 'yyyy-MM' period; longer periods are dates already."""
    return F.when(F.length(period) == 7, F.concat(period, F.lit("-01"))).otherwise(period).try_cast("date")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows as a relation."""
    return spark.createDataFrame(rows, schema)
