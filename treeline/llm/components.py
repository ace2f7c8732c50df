"""Connected components of a link table, without a driver-side graph.

Edges are rewritten by alternating star operations until they stop changing:
every node then has one edge, to the smallest node it can reach.  Each round is
written to the shared folder.  A node with many edges is split by the adaptive
skew join; minima are combined before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` have a < b: each node's smaller neighbours, and itself, get the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.union(own).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a long, b long; a < b) but the roots."""
    now, seen = materialize(edges.select("a", "b").distinct(), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen, then = state, now
        now = materialize(_small(_large(then)), "edges")
        drop(then)
