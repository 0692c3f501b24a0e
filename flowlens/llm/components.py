"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round.  edges: a > b.  Large star: neighbours above a node go to the least
    near it; small star: those below do.  Only minima meet, no neighbourhood is gathered."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.expr("a = u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large.where("a <> b").distinct(), "large")
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = large.join(low, F.expr("a = u"))
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return written(small.where("a <> b").distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of an edge is connected to.

    edges: columns a, b of one ordered type; loops and repeats do not matter.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    state = None
    while True:
        now = _stars(now)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
