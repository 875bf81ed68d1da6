"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.session import materialize


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``): the smallest
    node that it reaches.

    Each round links larger neighbours, then smaller ones, to the smallest node
    nearby; trees flatten at a logarithmic pace, and the work ends when only stars
    are left. Rounds are cut by a written table. Only whether there is more to do
    reaches the driver.
    """
    edges = links.where(F.col("a") != F.col("b"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_nearest(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b"))
        nearest = _nearest(large)
        small = large.join(nearest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            nearest.select("a", F.col("m").alias("b"))
        )
        edges = materialize(small.where(F.col("a") != F.col("b")).distinct(), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour or is the smallest of all."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
    odd = ends.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return odd.isEmpty()
