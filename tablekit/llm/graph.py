"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of ``edges`` (``a``, ``b``).

    Every round links neighbours to the smallest node around them; a node's
    neighbours are only ever reduced to a minimum, so hubs cost no more than their edges.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.store(ends.distinct(), "stars-0")
    step = 0
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours go to the smallest node around.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself go to the smallest of them; here a > b always.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        now = scratch.store(small, f"stars-{step}")
        scratch.drop(f"stars-{step - 1}")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` (larger than its ``b``) has one edge and no ``b`` is an ``a``: then ``b`` names its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not seen.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0)))).first()[0]
