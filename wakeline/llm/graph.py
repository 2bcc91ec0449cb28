"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum and one join; nothing is gathered on the driver but two numbers a round. Rows are two numbers wide; a node
of very many edges is left to Spark's splitting of skewed joins.
Every round's edges are a staged table, so that lineage stays short and lost executors are no matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges(u, v); other nodes are not listed."""
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every edge leads from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _digest(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
