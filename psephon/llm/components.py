"""Connected components of an undirected graph as DataFrames: alternating large and small stars.

A large star ties a node's larger neighbours to its least neighbour, a small star its smaller ones; after a few
rounds each component is one star around its least node. Edges never leave the executors; each round is cut off
by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b): the component's least node. Nulls and loops are no edges."""
    x.shared_dir(edges.sparkSession)
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct().checkpoint()
    state = None
    while True:
        edges = _small(_large(edges)).distinct().checkpoint()
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
