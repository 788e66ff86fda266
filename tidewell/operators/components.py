"""Connected components of an edge list, by alternating large and small stars; every round is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang every node's neighbours (small: those below it, and itself; large: those above it) on its least neighbour.

    A node with very many edges is a skewed key on one side of a join whose other side has one row a node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.filter("b < a") if small else both
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if small:
        hung = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.filter("a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.lit(1).alias("_")).drop("_")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads straight to a centre: no a has two edges, no b has one of its own."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + least(up, down) > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id that edges reach) of every node of edges (a, b); ends after O(log^2) rounds."""
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = materialise(edges, "edges")
    while not _is_stars(edges):
        before, edges = edges, materialise(_star(_star(edges, small=False), small=True), "edges")
        discard(before)
    # now every edge leads from a node straight to its component's least
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
