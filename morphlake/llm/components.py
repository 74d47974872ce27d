"""Connected components of an edge table by alternating large and small stars, all of it in DataFrames.

A large star ties every greater neighbour of a node to the smallest node around it; a small star does so for the smaller
ones. Rounds end when the edges no longer change: then each edge leads from a node to the smallest of its component.
The number of rounds grows with the logarithm of the longest path. Every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the greater node a to the smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).unionAll(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())


def roots(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (a, b); root is the smallest node of its component. Loops are ignored."""
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now.df)
    while seen[0]:
        after = store(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now, before, seen = after, seen, _state(after.df)
        if seen == before:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
