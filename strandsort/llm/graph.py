"""Connected components of an edge list, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsort.llm.common import cut


def components(edges: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Alternates large-star and small-star steps, each of which hangs neighbours on the least one known, until all that is
    left are stars: every node has either one neighbour, a lesser one, or greater ones only. O(log n) rounds on any graph.

    A node may have very many neighbours. Its least one is found by aggregations that combine before the shuffle. Then
    the table of least neighbours, one row a node, is joined to the edges: broadcast up to ``broadcast_rows`` edges
    (16 bytes a row), and beyond that by a shuffle join, whose partitions adaptive execution splits where one is skewed.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    held = (lambda df: F.broadcast(df)) if edges.count() <= broadcast_rows else (lambda df: df)  # rounds never add edges
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
        if near.filter("NOT (low > a OR (low = high AND low < a))").isEmpty():
            break
        least = near.select("a", F.least("low", "a").alias("m"))
        large = both.join(held(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(held(low), "a")
        edges = cut(small.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")))
    return near.select(F.col("a").alias("node"), F.least("low", "a").alias("component"))
