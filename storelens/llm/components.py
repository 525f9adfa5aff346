"""Connected components of an edge table, without gathering a component anywhere.

Alternating large-star and small-star steps: in a large-star step every node links its larger
neighbours to the least node it knows; in a small-star step its smaller ones, and itself. Both keep
components, and the edges become stars around the least node in a logarithmic number of rounds.
Each step is a grouped minimum, combined before the shuffle, and one equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    out = pairs.where(F.col("other") > F.col("node")).join(least, "node")
    return out.select(F.col("least").alias("a"), F.col("other").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges run from the smaller node a to the larger b.
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b")
    own = least.select(F.col("least").alias("a"), "b")
    return moved.where(F.col("a") != F.col("least")).select(F.col("least").alias("a"), F.col("a").alias("b")).union(own)


def components(edges: DataFrame, workspace: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node of its component."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = workspace.keep(edges.distinct())
    before = None
    for _ in range(max_rounds):
        # A sum of hashes tells whether a round changed anything.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = workspace.keep(_small_star(workspace.keep(_large_star(edges).distinct())).distinct())
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select(F.col("root").alias("node"), "root"))
