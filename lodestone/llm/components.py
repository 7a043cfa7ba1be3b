"""Connected components by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (bigint, any order, loops and repeats allowed) -> ``node``, ``component``, the smallest
    node of its component; only nodes with an edge to another node appear.

    A large star links each node's larger neighbours to its smallest one, a small star its smaller ones, until
    every node points to its component's smallest: a few rounds even for long chains. Minima are combined
    before the exchange; a hub's rows are spread by Spark's skew join.
    """
    spark = edges.sparkSession
    with scratch(spark):
        now = materialize(_directed(edges.select("a", "b")).distinct())
        state = None
        while True:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = materialize(_directed(small.unionByName(least.select("a", F.col("m").alias("b")))).distinct())
            row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(row) == state:
                break
            state = tuple(row)
        stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return materialize(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), keep=True)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
