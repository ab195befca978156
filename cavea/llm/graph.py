"""Connected components of an edge table, by alternating large and small stars.

Every round is an aggregation and a join; its edges are written to the shared
folder, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import spread_join, stored

MAX_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that isn't the least
    of its component; root is that least node. Loops and repeats don't matter."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "edges")
    seen = _print(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        # large star: a node's larger neighbours move to its least neighbour; a hub of
        # many edges is broadcast with its least neighbour
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        degree = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        targets = stored(degree.join(least.withColumnRenamed("a", "b"), "b", "left").select("b", F.coalesce("m", "b").alias("m"), "n"), "targets")
        edges = spread_join(edges, targets, ["b"], "n").select("a", F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the least of these
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        if (now := _print(edges)) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
