"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stored


def _are_stars(edges: DataFrame) -> bool:
    """Does every edge (v, u) lead from a leaf u with no other edge to a hub v that is no leaf?"""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return per.where("leaf > 1 or (leaf = 1 and hub = 1)").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its smallest node.

    Each round groups by node with partial aggregation and joins the minimum
    back, hubs apart from other nodes, so a hub with very many links is no
    single task's group; links only ever shrink towards stars. Rounds end when
    all edges are stars; the needed number is logarithmic in the number of nodes.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("links")), "low")
        large = stored(join_hot(both.where(F.col("v") > F.col("u")), low, "u", "links").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u != v").distinct(), "edges")
        discard(edges)
        discard(low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")), "low")
        small = join_hot(large, low, "u", "links").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u").where("u != v").distinct()
        edges = stored(small, "edges")
        discard(large)
        discard(low)
    else:
        raise RuntimeError("components did not settle")
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
