"""Connected components by alternating large and small stars, in Spark joins alone.

Each round costs a minimum by vertex, summed before the shuffle, and a join of the edges with it. Rounds grow with the
logarithm of the longest chain. Tables between rounds are written to the shared folder and removed when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each vertex's larger neighbours with the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each vertex and its smaller neighbours with the least of these. u > v in every edge."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """vertex, root: the smallest vertex of its component, for every vertex of an edge but the roots themselves.

    edges: u, v, of one orderable type. Edges to oneself and nulls don't count; repeated edges are one.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = scratch.write(start)
    seen = None
    for _ in range(max_rounds):
        large = scratch.write(_large_star(state))
        small = scratch.write(_small_star(large))
        scratch.drop(state)
        scratch.drop(large)
        state = small
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return state.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
