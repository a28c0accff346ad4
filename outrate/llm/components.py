"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.llm.common import table


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m, the least neighbour of u.  The minimum is found before the shuffle; of a node with a great part of all edges the
    join deals the rows out anew."""
    return edges.join(least, "u")


def stars(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that has a link but the smallest ones.

    Self links and repeated links do no harm; links with a null end are ignored.  Each round moves every link's greater end to the
    smallest neighbour, so a path shrinks by halves.  With rounds, it may end before all components are one star: then nodes of one
    component may have several, and all of them are connected by these stars.
    """
    edges, done = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.bool_or("moved").alias("any"))
        small = _star(large.select("u", "v"), least)
        # The row of the least neighbour keeps u's place, every other one moves to it.
        moved = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("any") | (F.col("v") != F.col("m"))).alias("moved"))
        edges, done = table(moved.where("u <> v").groupBy("u", "v").agg(F.bool_or("moved").alias("moved")), "stars"), done + 1
        if done == rounds or edges.where("moved").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = edges.select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that has a link."""
    found = stars(links)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
