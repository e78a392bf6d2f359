"""Connected components of an edge table, by alternating large-star and small-star rounds.

A round is two minima by group, combined before they travel, and joins with them that adaptive execution can split; no hub's
edges have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """edges(a, b) with the least b of each a as m."""
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    return edges.join(least, F.col("a") == F.col("c")).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): each node that is not the least of its component, with the least.

    Null ends and loops are dropped. Raises if MOST_ROUNDS don't suffice (they do for any graph that fits a cluster:
    rounds grow with the square of the logarithm of the longest path at most).
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        least = _least(large)
        small = least.select("a", F.col("m").alias("b")).unionByName(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = cut(small)
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if before == (sign["n"], sign["s"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (sign["n"], sign["s"])
    raise RuntimeError(f"components aren't done after {MOST_ROUNDS} rounds")
