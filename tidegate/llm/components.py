"""Connected components of links held as a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has a parent."""
    per_node = edges.groupBy("u").agg(F.count("*").alias("n"))
    if per_node.where("n > 1").isEmpty():
        return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()
    return False


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links of longs -> (node, component): component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges are stars; each step is a grouped
    minimum and an equi-join, so a node with very many links is pre-aggregated and split by AQE, and
    no neighbourhood is ever collected. Nulls and self-links are left out; no links give no rows.
    """
    edges = scratch.keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _is_forest_of_stars(edges):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.union(parent.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
