"""Connected components of links, by alternating large and small stars.

Every round points nodes at the smallest neighbour they know, with joins and grouped minima only, so
no component is ever gathered in one place.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them.  Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other that points at none: nothing is left to move."""
    state = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    if state.filter("n > 1").limit(1).count():
        return False
    return not edges.select(F.col("v").alias("u")).join(state, "u", "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (u, v) that has a smaller node to reach.

    ``component`` is the smallest id reachable; it does not appear as an id itself.  Loops, repeats
    and links with a null end are ignored.
    """
    edges = (
        links.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    while not _settled(edges):
        edges = _small_star(_large_star(edges)).checkpoint()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
