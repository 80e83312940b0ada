"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``u``, itself included; stored, so that the join with it can split a hub."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (least node reachable) for every node that has a link to another.

    ``links`` has one row per link, in either direction, repeats allowed; null ends and links to itself are
    ignored. Rounds repeat until nothing changes; each halves the distance to the least node at least, and
    every table is one row per link. A hub's rows meet in joins that adaptive execution splits, never in
    one group.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialise(edges)
    before = None
    while True:
        # every neighbour above a node is hung on the node's least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = materialise(edges.distinct())
        # every neighbour below a node, and the node, are hung on the least of them
        hung = edges.join(_least(edges), "u").where("v >= m")
        edges = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).where("u > v")
        edges = materialise(edges.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
