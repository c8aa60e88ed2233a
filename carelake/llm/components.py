"""Connected components of a graph too large for one task, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    onward = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return onward.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node with a link; ``root`` is the smallest node it reaches.

    ``edges`` has two long columns ``a`` and ``b``; loops, repeats and both
    directions are fine, rows with a null are no links. No links give no rows.
    Each round is written to the shared folder; the rounds grow with the
    logarithm of the longest path.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    stars, known = staged(links, "stars"), None
    while (now := _digest(stars)) != known:
        known = now
        stars = staged(_small_star(_large_star(stars)), "stars")
    leaves = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
