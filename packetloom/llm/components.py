"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the larger ones; small: the smaller ones) and, if small, itself to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u != v").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge. edges: a, b (long, not null), in any direction, repeated or not."""
    with scratch():
        now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = None
        while (count := _sum(now)) != before and count[0]:
            before = count
            now = _stars(_stars(now, True), False)
        nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return written(nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", keep=True)
