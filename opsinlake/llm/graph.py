"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.scratch import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One round of alternating stars. Every node hands its larger neighbours to the smallest node it sees, then its
    smaller ones; a node's minimum is a partial aggregate, so a hub costs one row per task before the shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
    root = large.groupBy("hi").agg(F.min("lo").alias("m"))
    linked = large.join(root, "hi")
    small = linked.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct().select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a root to a node that is no root and has no other."""
    twice = edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge other than to itself; root is the smallest node of its component.

    ``edges`` has columns ``a`` and ``b``. Rounds follow the logarithm of the longest chain; each is written to the
    shared folder, and only the answer whether it was the last comes to the driver.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _settled(edges):
        edges = cut(_stars(edges))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
