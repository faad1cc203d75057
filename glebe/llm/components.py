"""Connected components by alternating large and small stars; no task or driver holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glebe.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Each round hangs all larger neighbours of a node under its least one, then all smaller ones, until nothing
    changes; the rounds grow with the logarithm of the nodes. Minima are pre-aggregated, and the joins that spread
    them may be split at a crowded node. Loops and repeated edges are fine.
    """
    state = stage(_down(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "stars")
    seen = None
    while (mark := state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = mark
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = stage(_down(small), "stars")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select("v", "v").distinct())


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u > v").distinct()
