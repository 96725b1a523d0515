"""Connected components by alternating large-star and small-star steps, as DataFrame operations.

Every step is a grouped minimum and an equi-join, so partial aggregation and skew splitting apply to
hubs; nothing is collected but one count per round.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import drop_staged, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(around: DataFrame) -> DataFrame:
    """For each node's neighbours b, the smallest of the node and its neighbours as ``low``."""
    low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return around.join(low, "a")


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    return _star(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)`` but roots alone.

    Self-loops and repeated links change nothing; an empty edge table gives an empty result.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = _large(now).where("a != b").distinct()
        after = staged(_small(large).where("a != b").distinct(), "edges")
        drop_staged(now)
        now = after
        # The fixed point is a star forest: no node has two parents and no parent has one.
        n, check = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, check) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = n, check
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
