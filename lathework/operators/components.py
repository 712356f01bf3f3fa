"""Connected components of a graph by alternating stars.

Every round hangs a node's neighbours on the least node it knows: first those
above it (large stars), then those below (small stars). The edges become a
star a component in a number of rounds that grows with the logarithm of its size
squared at most. A round is two aggregations by node, which combine before the
shuffle, and joins with one row a node on one side, which adaptive execution splits at a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches. Nodes may be
    numbers, texts or structs of them; edges with a null end are ignored, nodes with an edge to
    themselves alone are their own component, and nodes without an edge have no row."""
    known = cut(edges.filter("a is not null and b is not null").select("a", "b").distinct())
    stars, before = known.filter("a <> b"), None
    while True:
        stars = cut(_small(_large(stars)))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
