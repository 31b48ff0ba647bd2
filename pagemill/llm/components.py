"""Connected components of edges, by alternating stars: every step is a hash aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import removed, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the least node of its component, for all nodes of `edges` (`u`, `v`) but the roots.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round; the table of
    the round before goes then.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.folder = now.folder
            return out
        seen, before = mark, now
        now = written(_small_star(_large_star(before)), "edges")
        removed(before)
