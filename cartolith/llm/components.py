"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import drop_written, spread_join, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) move to its smallest neighbour.

    total: the number of edges, at most; a node's edges are dealt over several tasks by it.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = spread_join(both, least, ["u"], "n", 2 * total if large else total, F.xxhash64("v"))
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach. edges: u, v, in any direction.

    Each round is written to the shared folder; the rounds grow as the logarithm of the longest path. Smallest
    neighbours are pre-aggregated and its edges dealt over tasks, so a node with very many edges is no task of its own.
    """
    now = written(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        total = now.count()
        after = written(_star(_star(now, True, total), False, total).distinct(), "edges")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        drop_written(now)
        now = after
        if tuple(sign) == state:
            break
        state = tuple(sign)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
