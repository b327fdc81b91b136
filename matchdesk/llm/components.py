"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("low")), both


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to its smallest neighbour (or itself)."""
    low, both = _least(edges)
    low = low.withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    near = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return near.unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node
    reachable. Each round is written to the shared folder; the rounds end when the
    edges are stars: no node is both child and root, and none has two roots."""
    edges = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "small-star")
        roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if roles.where("child + root > 1").isEmpty():
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
