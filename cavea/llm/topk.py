"""Exact top-k inner products with block-at-a-time pruning.

Vectors are numbered so that alike ones are neighbours: each goes to the cell of the
pivot (of a bounded sample of vectors) it is most alike, and by likeness within. The
numbers are cut by range into blocks. A block keeps its forward index (the vectors
themselves) and each term's largest and smallest value, so a query's score in the
block is at most the sum over terms of q * max (q >= 0) or q * min (q < 0). Each query
takes its blocks in falling order of that bound and stops when the next bound is
below its kth score; equal bounds are still scored, for ties go to the smaller id.

A query first searches the group of blocks of its own cell, and takes the kth score
found there to all other groups as the score to beat. Queries travel in lots; a task
holds one group and one lot and returns k rows a query, which are merged by rank.
``block_counts`` tells how many blocks were scored. In vectors without any structure
(independent components) no bound by term maxima falls below the kth score, and all
blocks are scored, by dense products.

Defined cases: a vector that is null, empty or holds a null or non-finite value
takes no part; vectors of unequal length are compared over the shorter; rows with
one id are no candidates of each other, and rank together as one query; repeated rows
are one each; an integer beyond 64 bits, of a component or a score, is the nearest of
64 bits, after ranking by exact scores; vectors of any length are read whole; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

K = 20
#: Vectors of a block, of a group of blocks (one task's share), and queries that travel together.
BLOCK = 64
GROUP = 4096
QUERIES = 8192
#: Vectors of the sample that name the cells.
PIVOTS = 64
#: Whole numbers stay exact in float64 products below this sum of magnitudes.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v the floor of scale * component, of usable vectors."""
    e = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(rows: pd.Series) -> np.ndarray:
    """Rows as one matrix, short ones filled with zeros."""
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_in_group(
    qid: np.ndarray, q: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int, block: int = BLOCK, beat: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best among ``docs`` that reach the score
    to beat, and the blocks scored. Blocks are cut in the order of ``docs``."""
    width = min(q.shape[1], docs.shape[1])
    exact = np.abs(q.astype(float)).sum(1).max(initial=0) * np.abs(docs.astype(float)).max(initial=0) < EXACT
    q, docs = q[:, :width].astype(float if exact else object), docs[:, :width].astype(float if exact else object)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    none = float("-inf")
    top_score = np.full((len(q), k), none, object if not exact else float)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    least = np.full(len(q), none) if beat is None else beat
    live, scored = np.arange(len(q)), 0
    for step in range(len(starts)):
        ahead = bound[live, turn[live, step]]
        live = live[(ahead >= top_score[live, k - 1]) & (ahead >= least[live])]
        if not len(live):
            break
        chosen = turn[live, step]
        for b in np.unique(chosen):
            own = live[chosen == b]
            lo, hi = starts[b], min(starts[b] + block, len(ids))
            score = q[own] @ docs[lo:hi].T
            score[qid[own][:, None] == ids[lo:hi]] = none
            score[score < least[own][:, None]] = none
            scored += len(own)
            score = np.concatenate((top_score[own], score), 1)
            name = np.concatenate((top_id[own], np.broadcast_to(ids[lo:hi], (len(own), hi - lo))), 1)
            pick = np.lexsort((name, -score), axis=1)[:, :k]
            top_score[own], top_id[own] = np.take_along_axis(score, pick, 1), np.take_along_axis(name, pick, 1)
    row, place = np.nonzero(top_score > none)
    found = top_score[row, place]
    if not exact:
        found = np.array([max(min(int(x), LARGEST), -LARGEST - 1) for x in found], np.int64)
    return row, top_id[row, place], found.astype(np.int64), scored


def with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, v) with ``cell``, the number of the pivot most alike, and
    ``near``, the likeness to it."""
    length = np.sqrt((pivots.astype(float) ** 2).sum(1))
    unit = pivots / np.maximum(length, 1e-300)[:, None] if len(pivots) else np.zeros((1, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = matrix(b["v"]).astype(float)
                width = min(m.shape[1], unit.shape[1])
                alike = m[:, :width] @ unit[:, :width].T
                b["cell"], b["near"] = alike.argmax(1).astype(np.int32), alike.max(1)
                yield b

    return vectors.mapInPandas(run, "vec_id long, v array<long>, cell int, near double")


def _groups(sizes: dict[int, int], group: int) -> dict[int, tuple[int, int]]:
    """(first group, number of groups) of each cell: small cells share a group, large
    ones have several."""
    out, at, held = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if held and held + n > group:
            at, held = at + 1, 0
        parts = max(1, -(-n // group))
        out[cell] = at, parts
        if parts > 1:
            at, held = at + parts, 0
        else:
            held += n
    return out


def _scored(vectors: DataFrame, queries: DataFrame, k: int, group: int, lot_of: int) -> DataFrame:
    """Rows (query_id, vec_id, score) of the k best of each group, and, without a
    query_id, (blocks scored, blocks) of each task."""
    spark = vectors.sparkSession
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vec_id"), F.xxhash64("v")).limit(PIVOTS).collect()]
    pivots = matrix(pd.Series(sample)) if sample else np.zeros((0, 0), np.int64)
    vectors, queries = stored(with_cells(vectors, pivots), "vectors"), stored(with_cells(queries.distinct(), pivots), "queries")
    placed = _groups({r[0]: r[1] for r in vectors.groupBy("cell").count().collect()}, group)  # one row a pivot
    groups = max((first + n for first, n in placed.values()), default=1)
    lots = max(1, -(-queries.count() // lot_of))
    hashed = F.xxhash64("vec_id")
    table = spark.createDataFrame([(c, first, n) for c, (first, n) in placed.items()], "cell int, first int, parts int")
    at = (F.coalesce("first", F.lit(0)) + F.pmod(hashed, F.coalesce("parts", F.lit(1)))).cast("int")
    sides = vectors.join(F.broadcast(table), "cell").select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), at.alias("grp"), "vec_id", "v", "cell", "near")
    asked = queries.join(F.broadcast(table), "cell", "left").select(F.pmod(hashed, F.lit(lots)).cast("int").alias("lot"), at.alias("home"), F.col("vec_id").alias("query_id"), "v")

    def score(_, docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        docs = docs.sort_values(["cell", "near", "vec_id"], ascending=[True, False, True])
        qid = wanted["query_id"].to_numpy()
        row, ids, points, blocks = best_in_group(qid, matrix(wanted["v"]), docs["vec_id"].to_numpy(), matrix(docs["v"]), k, beat=wanted["beat"].fillna(float("-inf")).to_numpy(float))
        told = pd.DataFrame({"query_id": [None], "vec_id": [blocks], "score": [len(qid) * -(-len(docs) // BLOCK)]})
        return pd.concat([pd.DataFrame({"query_id": qid[row], "vec_id": ids, "score": points}).astype({"query_id": "object"}), told])

    def met(wanted: DataFrame) -> DataFrame:
        return sides.groupBy("lot", "grp").cogroup(wanted.groupBy("lot", "grp")).applyInPandas(score, "query_id long, vec_id long, score long")

    home = stored(met(asked.select("lot", F.col("home").alias("grp"), "query_id", "v", F.lit(None).cast("double").alias("beat"))), "home-scores")
    # k scores of one group are the score to beat elsewhere; above 2^53 the double is rounded down
    kth = home.filter("query_id is not null").groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    beat = F.when(F.col("n") >= k, F.when(F.abs(F.col("low").cast("double")) < EXACT, F.col("low").cast("double")))
    others = asked.join(kth, "query_id", "left").select("lot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "home", "query_id", "v", beat.alias("beat"))
    return home.unionByName(met(others.filter("grp <> home").drop("home")))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, group: int = GROUP, batch_of: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` (vec_id, v)
    for each row of ``queries``; a query's own id is no candidate."""
    near = _scored(vectors, queries, k, group, batch_of).filter("query_id is not null")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_counts(vectors: DataFrame, queries: DataFrame, k: int = K, group: int = GROUP, batch_of: int = QUERIES) -> DataFrame:
    """One row: the pairs of a query and a block that were scored, and all such pairs."""
    told = _scored(vectors, queries, k, group, batch_of).filter("query_id is null")
    return told.agg(F.coalesce(F.sum("vec_id"), F.lit(0)).alias("scored"), F.coalesce(F.sum("score"), F.lit(0)).alias("blocks"))


def top_products(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The k best rows for each vector whose id is divisible by ``every``."""
    ready = integers(vectors)
    return search(ready, ready.filter(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
