"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join, so no component is ever gathered in a task or in the driver. Edges shrink
to stars whose centre is the smallest node of the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import settle


def _mark(edges: DataFrame) -> tuple:
    """A number that two equal edge sets share."""
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); `component` is the smallest node that is reachable."""
    order = F.when(F.col("a") > F.col("b"), F.struct("a", "b")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    # every edge points from the larger node to the smaller one
    edges = settle(edges.filter("a != b").select(order.alias("e")).select("e.*").distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest one
        large = edges.join(least.withColumnRenamed("a", "b"), "b").filter("a != m").select("a", F.col("m").alias("b"))
        large = settle(large.distinct())
        # small star: smaller neighbours and the node itself move to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
