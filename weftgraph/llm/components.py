"""Connected components of a graph of long identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): each node that has an edge, and the smallest node of its component.

    Every step is a groupBy for the minimum and a join back, so a hub is a key whose rows the
    optimiser may split; lineage is cut by a table after each step. The number of steps
    grows with the logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges)
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.filter("a <> b").distinct(), edges)
        now = _mark(edges)
        if now == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
