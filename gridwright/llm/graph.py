"""Connected components of a large graph, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges (``u``, ``v``, longs): the root is the smallest node reached.

    Every round hangs each node's larger neighbours, then its smaller ones, under the smallest
    neighbour; the number of rounds grows with the logarithm of the longest path. A round is two
    aggregates, each joined back to the edges (the aggregate has one row per node, so a hub is
    split by adaptive execution), and ends in a stored table. Runs until nothing changes.
    """
    current = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = _state(current)
    while seen[0]:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(lower, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        # a node keeps its own link to the smallest neighbour: the row whose v is m gives it
        following = materialise(small.distinct())
        now = _state(following)
        current, done = following, now == seen
        seen = now
        if done:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
