"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Labels and edges stay distributed; every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import drop, written


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): root is the smallest node of the component; nodes without an edge have no row."""
    now = written(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        before, now = now, written(spark, _edges(small_star(_edges(large_star(now)))), "edges")
        drop(before)
        found = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    # a star: every node but the root has one edge, to the root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
