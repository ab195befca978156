"""Components and breadth-first layers of graphs, many graphs at once.

Components are found in two steps: tasks join what lies in one brick (a part of the graph
of bounded size), and rounds over the whole graph see only what is left of each brick, one
node a local component, and the edges between bricks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .steps import settled, written

MAX_ROUNDS = 100


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, under edges a - b."""
    label = np.arange(n)
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def _local(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, l): nodes that are not the least of their component within a brick, and
    the least. ``edges``: keys, a, b, brick."""
    shape = ", ".join(f"`{c}` {t}" for c, t in edges.select(*keys).dtypes)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(group[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        label = least_labels(len(nodes), at[:, 0], at[:, 1])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        out = {k: [group[k].iloc[0]] * len(moved) for k in keys}
        return pd.DataFrame(out | {"n": nodes[moved], "l": nodes[label[moved]]})

    return edges.groupBy(*keys, "brick").applyInPandas(join, f"{shape}, n long, l long")


def contracted(labels: DataFrame, cross: DataFrame, keys: list[str]) -> DataFrame:
    """``labels`` (keys, l and further columns) with l the least label that ``cross`` (keys,
    a, b: labels) joins it to."""
    cross = settled(cross.filter("a <> b").distinct())
    if cross.isEmpty():
        return labels
    nodes = cross.select(*keys, F.col("a").alias("n")).unionByName(cross.select(*keys, F.col("b").alias("n"))).distinct()
    roots = _rounds(nodes, cross, keys).select(*keys, F.col("l").alias("_root"), F.col("n").alias("l"))
    return labels.join(roots, [*keys, "l"], "left").withColumn("l", F.coalesce("_root", "l")).drop("_root")


def components(vertices: DataFrame, edges: DataFrame, keys: list[str], node: str = "flat", out: str = "comp") -> DataFrame:
    """``vertices`` with ``out``, the least node of its component.

    ``edges`` has ``keys``, a, b, and ``brick`` if an edge lies in one (null where it
    crosses between two); ``keys`` tell graphs apart.
    """
    if "brick" not in edges.columns:
        edges = edges.withColumn("brick", F.lit(None).cast("string"))
    edges = settled(edges.select(*keys, "a", "b", "brick"))
    own = vertices.select(*keys, F.col(node).alias("n")).distinct()
    labels = own.join(_local(edges.filter("brick is not null"), keys), [*keys, "n"], "left").withColumn("l", F.coalesce("l", "n"))
    labels = settled(labels)
    cross = edges.filter("brick is null")
    for end in ("a", "b"):
        cross = cross.join(labels.select(*keys, F.col("n").alias(end), F.col("l").alias(f"_{end}")), [*keys, end])
    labels = contracted(labels, cross.select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b")), keys)
    return vertices.join(labels.withColumnsRenamed({"n": node, "l": out}), [*keys, node])


def _rounds(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, l): the least node l of the component of each of ``nodes`` (keys, n).

    Each round takes the least label of the neighbours and then the label's own label, so
    the number of rounds follows the logarithm of the diameter in the main.
    """
    both = settled(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settled(nodes.withColumn("l", F.col("n")))
    last = None
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnsRenamed({"n": "b", "l": "near"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "n"), [*keys, "n"], "left").withColumn("l", F.least("l", "near")).drop("near")
        for _ in range(2):
            step = step.join(step.select(*keys, F.col("n").alias("l"), F.col("l").alias("up")), [*keys, "l"], "left").select(*keys, "n", F.least("l", "up").alias("l"))
        labels = settled(step)
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == last or now is None:
            return labels
        last = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def layers(starts: DataFrame, links: DataFrame, keys: list[str], most: int = 10_000, until: str | None = None) -> DataFrame:
    """Depth of every node reached from ``starts`` (keys, n) over ``links`` (keys, a, b, each
    both ways): keys, n, depth, pred (the least predecessor).

    Links go both ways, so a new node can only be one of the last two layers, and no layer
    before is read again. ``until`` names a column of ``starts``: a graph stops once its
    layers from 1 on hold so many nodes.
    """
    kept = [*keys, until] if until else keys
    first = starts.select(*kept, "n", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("pred"), (F.col(until) if until else F.lit(1)).cast("long").alias("_left"))
    read = starts.sparkSession.read.schema(first.schema)
    folders = [written(first)]  # a layer each, so no layer is written twice
    here, before = read.parquet(*folders), None
    frontier = here
    for depth in range(1, most + 1):
        ahead = frontier.join(links.withColumnRenamed("a", "n"), [*keys, "n"]).groupBy(*kept, "_left", "b").agg(F.min("n").alias("pred")).withColumnRenamed("b", "n")
        seen = here if before is None else here.unionByName(before)
        new = ahead.join(seen.select(*keys, "n"), [*keys, "n"], "left_anti").select(*kept, "n", F.lit(depth).alias("depth"), "pred", "_left")
        folders.append(written(new))
        before, here = here, read.parquet(folders[-1])
        if here.isEmpty():
            break
        frontier = here
        if until:
            width = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("_width"))
            frontier = here.join(width, keys).withColumn("_left", F.col("_left") - F.col("_width")).filter("_left > 0").drop("_width")
    return read.parquet(*folders).drop("_left")
