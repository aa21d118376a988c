"""Connected components by alternating stars, as joins and aggregates over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour moves to the smallest of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    moved = both.filter("b > a").join(low, "a").select("b", "low")
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a")
    near = moved.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return near.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): the root is the smallest node reachable.

    Edges never grow in number, a hot node is only ever one side of a join, and each
    round is stored, so a lost executor costs one round. Ends when a round changes
    nothing; no links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct())
    seen = _mark(edges)
    for _ in range(most):
        edges = stored(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == seen:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = now
    raise ValueError(f"components did not settle in {most} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: equal for equal sets of edges."""
    code = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(code)).first())
