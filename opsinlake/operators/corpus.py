"""Corpus hierarchy of stimuli: slash-separated batch paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_path(batch: Column) -> Column:
    """Trimmed, non-blank segments of a batch path; empty when there is none."""
    parts = F.filter(F.transform(F.split(batch, "/"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(parts, F.expr("cast(array() as array<string>)"))


def corpus_nodes(curves: DataFrame, batch: Column) -> DataFrame:
    """Each curve once per node above it: ``node`` (path prefix), ``level`` and ``direct`` (placed right there).

    A curve without a path is its own root, ``level`` 0.
    """
    tagged = curves.withColumn("_p", corpus_path(batch))
    depth = F.size("_p")
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array(F.lit(0)))
    leveled = tagged.withColumn("level", F.explode(levels))
    node = F.when(F.col("level") > 0, F.array_join(F.slice("_p", 1, F.col("level")), "/"))
    return leveled.withColumn("node", node).withColumn("direct", F.col("level") == F.size("_p")).drop("_p")


def corpus_counts(curves: DataFrame, batch: Column) -> DataFrame:
    """Curves at and below every node, and those placed directly in it. Counting is combined before the shuffle,
    so a node that holds a third of all curves costs one row per task."""
    nodes = corpus_nodes(curves.select(batch.alias("_batch")), F.col("_batch")).where("level > 0")
    return nodes.groupBy("node", "level").agg(
        F.count(F.lit(1)).alias("curves"), F.count_if("direct").alias("direct_curves")
    )


def under(curves: DataFrame, batch: Column, node: str) -> DataFrame:
    """Curves at or below one node."""
    want = [s.strip() for s in node.split("/") if s.strip()]
    return curves.where(F.slice(corpus_path(batch), 1, len(want)) == F.lit(want))
