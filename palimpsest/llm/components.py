"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least of each node and its neighbours, from edges given in the directions that count."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b), root being the component's least node. Loops and repeated links are fine.

    A large star links each node's larger neighbours to the least of its neighbourhood, a small star its smaller ones; both keep
    components, and the edges end as stars around the least nodes. The number of rounds grows with the logarithm of the nodes.
    The least neighbour is summed before it is shuffled, and both sides of the join are tables, so AQE splits the edges of a hub.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        star = large.join(_least(large), "a")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b")))
        last, edges = edges, written(small.where("a <> b").distinct())
        discard(last, large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    named = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
    discard(edges)
    return named
