"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two joins on aggregated minima; nothing is collected. Each round's edges are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._shared import cut


def _sum(edges: DataFrame) -> tuple:
    """Row count and an order-free hash of the edges: the same when nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): each node that has an edge to another one, with the smallest node of its component.

    Self-edges and repeated edges change nothing; edges with a null end are left out; no edges give no rows.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct())
    before = _sum(now)
    while before[0]:
        now = cut(_small_star(_large_star(now)))
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
