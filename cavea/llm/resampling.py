"""Resampling documents towards a target distribution, by importance weights.

Features are runs of one to three words, hashed into ``BUCKETS`` buckets. A bucket's gain
is the logarithm of its share among the target's features over its share among all
documents' (both smoothed by one), in thousandths; a document's weight is the sum over its
features. With Gumbel noise added to the weights, the highest scores are a sample drawn
without replacement in proportion to the weights' exponentials.

* **Weights.** Tasks count buckets in arrays; sums over tasks are one row a bucket, and
  the table of gains (``BUCKETS`` whole numbers) is all that travels.
* **Ranks**, by parallel sorting by regular sampling: scores, without texts, are dealt to
  runs, each sorted in its task; each run gives samples at regular places; of the sorted
  samples every run-th is a splitter; rows are exchanged by splitter, so that no part has
  over twice its share, as rows are told apart by (run, place) where all else is equal;
  each part is put in order by itself, and the counts of the parts before it give its
  ranks. The driver sees ``runs`` squared samples, with at most ``MOST_RUNS`` runs.

Defined cases: a null or empty text has no features and the weight 0, as has any document
where all tables are empty; a null id has the noise of the word ``null``, and is ordered
first among equal scores; repeated rows are one each, in any order among themselves; texts
are read whole, however long; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, lean, stored, strings

BUCKETS, WORDS, SEED = 10_000, 3, 42
#: Documents under so many words aren't drawn; the share that is, in per cent.
LEAST_WORDS, PERCENT = 20, 5
#: Rows of a run, and runs at most.
RUN_ROWS, MOST_RUNS = 250_000, 512

#: A-Z to lower case; ASCII other than letters and digits to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; all beyond ASCII are letters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def features(words: list[bytes], longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each run of 1 to ``longest`` words."""
    crc, out = zlib.crc32, []
    spaced = [b" " + w for w in words]
    held = [crc(w) for w in words]
    for n in range(1, min(longest, len(words)) + 1):
        out += held
        held = [crc(w, c) for c, w in zip(held, spaced[n:])]
    return np.array(out, np.int64) % buckets


def bucket_counts(texts: DataFrame, longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of ``text`` in each bucket, over all rows."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in strings(b.column(0)):
                total += np.bincount(features(words_of(text), longest, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield batch(schema, held.astype(np.int32), total[held])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc: int | None) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: np.ndarray, longest: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                words = words_of(text)
                own = features(words, longest, len(gain))
                weight = int(gain[own].sum())
                out.append((doc, len(words), len(own), weight, weight + noise(seed, doc)))
            if out:
                yield batch(schema, *zip(*out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def ranked(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows`` (score, doc_id and further columns) with ``rank`` from 1, by falling score
    and then by doc_id."""
    spark, columns = rows.sparkSession, rows.columns
    n = rows.count() if n is None else n
    runs = min(MOST_RUNS, max(2, -(-n // RUN_ROWS)))
    fields = [*columns, "_run", "_at"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A number for each row of a run, in order."""
        at = 0
        for b in batches:
            if b.num_rows:
                yield b.append_column("_at", pa.array(np.arange(at, at + b.num_rows)))
                at += b.num_rows

    dealt = rows.repartition(runs).withColumn("_run", F.spark_partition_id()).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"))
    shape = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    local = stored(dealt.mapInArrow(numbered, f"{shape}, _at long"), "runs")
    sizes = {r["_run"]: r["n"] for r in local.groupBy("_run").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a run
    # regular places of each run, runs of them
    places = spark.createDataFrame([(k, size * i // runs) for k, size in sizes.items() for i in range(runs) if i < size], "_run int, _at long")
    keys = ["score", "doc_id", "_run", "_at"]
    sample = local.select(*keys).join(F.broadcast(places.distinct()), ["_run", "_at"]).select(*keys).collect()
    rank = lambda r: (-r["score"], r["doc_id"] is not None, r["doc_id"] or 0, r["_run"], r["_at"])
    sample = sorted(map(rank, sample))
    splitters = np.array([sample[i * len(sample) // runs] for i in range(1, runs)] if sample else [], np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(splitters)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of splitters up to each row."""
        cuts = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(b.schema.get_field_index("doc_id"))
            own = [-b.column(b.schema.get_field_index("score")).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy(), *(b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_run", "_at"))]
            every = np.concatenate((cuts, np.stack(own, 1).astype(np.int64)))
            kind = np.repeat([0, 1], (len(cuts), b.num_rows))  # a splitter comes before its own row
            order = np.lexsort((kind, *every.T[::-1]))
            part = np.empty(len(every), np.int64)
            part[order] = np.cumsum(kind[order] == 0)
            yield b.append_column("_part", pa.array(part[len(cuts) :].astype(np.int32)))

    parts = stored(local.mapInArrow(parted, ", ".join(f"`{c}` {t}" for c, t in local.dtypes) + ", _part int"), "parted")
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    before = np.concatenate(([0], np.cumsum([counts.get(k, 0) for k in range(runs)])))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks of a part's rows, which arrive in order."""
        at = 0
        for b in batches:
            if b.num_rows:
                part = b.column(b.schema.get_field_index("_part"))[0].as_py()
                rank = pa.array(np.arange(b.num_rows) + int(before[part]) + at + 1)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), rank], names=[*columns, "rank"])
                at += b.num_rows

    merged = parts.repartitionById(runs, F.col("_part")).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"), "_run", "_at")
    return merged.select(*fields, "_part").mapInArrow(counted, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", rank long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its ``rank`` if it is
    drawn: the highest ``percent`` of the scores of documents with ``least_words`` or more."""
    table = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    every = stored(scored(docs, table, longest, seed), "scores")
    fit = every.filter(F.col("n_words") >= least_words)
    n = fit.count()
    placed = ranked(fit, n).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = every.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
