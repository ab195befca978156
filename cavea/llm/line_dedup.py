"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

``count_lines`` makes the exact table (line hash, reference count, largest document
id). It is a sum over documents, so ``insert`` and ``delete`` of documents are
additions and subtractions of counts. ``filters_of`` builds a cuckoo filter for each
shard of the hash space in tasks, holding the shard's frequent lines; ``followed``
inserts and deletes lines as the counts change. Counts and filters are tables that can
be kept and handed to ``drop_lines`` again.

The lines of all documents ask the filters first; hits alone meet the exact table, so
a filter's false positives never change a result. Filters travel to the tasks in
rounds of ``FILTER_BYTES``, so that their number may grow. Lines in many documents
are broadcast where they meet their hits.

Defined cases: a null or empty text is one empty line; a document is an id, so rows of
one id count once, lose the same lines, and all keep them where the id is the largest; a
row without an id doesn't count and keeps its lines; the result has a row a row; lines
under ``min_chars`` code points are never dropped; texts are read whole, however
long; an empty table gives no rows; other columns are not read by ``line_digests``
and pass through ``drop_lines``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch, fresh, lean, mix64, spread_join, stored, strings

MIN_CHARS = 40
MIN_DOCS = 5
#: Shards of the hash space, at least; their number grows with the frequent lines.
SHARDS, SHARD_LINES = 64, 500_000
#: Filters that travel to the tasks at a time.
FILTER_BYTES = 64 << 20

SPACE = " \t\n\v\f\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is too short."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").translate(LOWER))


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; supports deletion.

    Keys arrive as arrays of uint64. What finds no place after ``KICKS`` moves goes
    to an exact overflow list, so that no key is ever lost.
    """

    KICKS = 500

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * 4 * 0.9 < max(capacity, 4):
            buckets *= 2
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, 4), np.uint16)
        self.overflow: list[int] = []
        self._turn = 0

    @classmethod
    def of(cls, slots: bytes, overflow: list[int]) -> CuckooFilter:
        """A filter from its stored form."""
        made = cls(0)
        made.slots = np.frombuffer(slots, np.uint16).reshape(-1, 4).copy()
        made.mask = np.uint64(len(made.slots) - 1)
        made.overflow = [x & 0xFFFFFFFFFFFFFFFF for x in overflow]
        return made

    def row(self, shard: int) -> dict:
        """The stored form."""
        signed = np.array(self.overflow, np.uint64).view(np.int64).tolist()
        return {"shard": [shard], "slots": [self.slots.tobytes()], "overflow": [signed]}

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(keys, np.uint64))
        mark = ((h >> np.uint64(48)).astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return mark, first, first ^ (mix64(mark.astype(np.uint64)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._at(keys)
        hit = (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)
        return hit | np.isin(keys, np.array(self.overflow, np.uint64)) if self.overflow else hit

    def insert(self, keys: np.ndarray) -> None:
        for key, mark, a, b in zip(np.asarray(keys, np.uint64).tolist(), *(x.tolist() for x in self._at(keys))):
            if not (self._put(a, mark) or self._put(b, mark) or self._move(b, mark)):
                self.overflow.append(key)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
        return len(free) > 0

    def _move(self, bucket: int, mark: int) -> bool:
        """Kicks entries on; undoes every move if no place is found."""
        trail = []
        for _ in range(self.KICKS):
            self._turn = (self._turn * 5 + 1) & 3
            trail.append((bucket, self._turn, int(self.slots[bucket, self._turn])))
            self.slots[bucket, self._turn], mark = mark, trail[-1][2]
            bucket ^= int(mix64(np.array([mark], np.uint64))[0] & self.mask)
            if self._put(bucket, mark):
                return True
        for where, slot, old in reversed(trail):
            self.slots[where, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        for key, mark, a, b in zip(np.asarray(keys, np.uint64).tolist(), *(x.tolist() for x in self._at(keys))):
            if key in self.overflow:
                self.overflow.remove(key)
                continue
            for bucket in (a, b):
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break


def _hash_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hash, doc_id), once for each row and distinct long line."""
    schema = pa.schema([("hash", pa.binary()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                own = {h for line in text.split("\n") if len(line) >= min_chars and (h := line_hash(line, min_chars))}
                hashes += own
                ids += [doc] * len(own)
            yield batch(schema, hashes, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "hash binary, doc_id long")


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("hash").agg(F.count_distinct("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference-count table: hash, refs, last_doc."""
    return _counted(_hash_rows(docs, min_chars))


def insert(counts: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``counts`` after the documents ``docs`` have been added, whole: none of their ids is
    counted yet."""
    return counts.unionByName(count_lines(docs, min_chars)).groupBy("hash").agg(F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc"))


def delete(counts: DataFrame, gone: DataFrame, left: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``counts`` after the documents ``gone`` have been taken out again.

    ``left`` holds the documents that stay; it is read only for lines whose last
    document goes, to find the largest id among the others.
    """
    less = count_lines(gone, min_chars).select("hash", F.col("refs").alias("_less"), F.col("last_doc").alias("_gone"))
    rest = counts.join(less, "hash", "left").withColumn("refs", F.col("refs") - F.coalesce("_less", F.lit(0))).filter("refs > 0")
    stale = rest.filter(F.col("_gone") >= F.col("last_doc")).select("hash")
    again = _hash_rows(left, min_chars).join(stale, "hash", "left_semi").groupBy("hash").agg(F.max("doc_id").alias("_last"))
    return rest.join(again, "hash", "left").select("hash", "refs", F.coalesce("_last", "last_doc").alias("last_doc"))


def frequent(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return counts.filter(F.col("refs") >= min_docs)


FILTER = "shard int, slots binary, overflow array<long>"


def _keys(hashes) -> np.ndarray:
    """The filters' keys: the first half of each hash."""
    return np.frombuffer(b"".join(bytes(h) for h in hashes), np.uint64)[::2]


def _shard(shards: int):
    """Shard of a hash, as a column."""
    return F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int")


def filters_of(often: DataFrame, shards: int | None = None) -> DataFrame:
    """(shard, slots, overflow): the cuckoo filter of each shard's frequent lines."""
    shards = shards or max(SHARDS, -(-often.count() // SHARD_LINES))

    def build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(max(2 * len(lines), 64))  # room to insert as many again
        made.insert(_keys(lines["hash"]))
        return pd.DataFrame(made.row(key[0]))

    every = often.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    built = often.select("hash", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTER)
    none = F.lit(CuckooFilter(64).slots.tobytes())
    return every.join(built, "shard", "left").select("shard", F.coalesce("slots", none).alias("slots"), F.coalesce("overflow", F.array().cast("array<bigint>")).alias("overflow"))


def followed(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``filters`` after the counts ``before`` became ``after``: lines that became
    frequent are inserted, those no longer frequent deleted."""
    shards = filters.count()
    old, new = (frequent(c, min_docs).select("hash", F.lit(True).alias(n)) for c, n in ((before, "was"), (after, "now")))
    changed = old.join(new, "hash", "full").filter("was is null or now is null").select("hash", F.col("now").isNotNull().alias("now"), _shard(shards).alias("shard"))

    def update(key: tuple, held: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        own = CuckooFilter.of(held["slots"][0], list(held["overflow"][0]))
        own.delete(_keys(lines.loc[~lines["now"], "hash"]))
        own.insert(_keys(lines.loc[lines["now"], "hash"]))
        return pd.DataFrame(own.row(key[0]))

    return filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(update, FILTER)


def _hits(lines: DataFrame, filters: DataFrame) -> DataFrame:
    """The (hash, doc_id) whose hash a filter holds, round by round of filters."""
    spark = lines.sparkSession
    sizes = {r[0]: r[1] for r in filters.select("shard", F.length("slots") + 8 * F.size("overflow")).collect()}  # one number a shard
    shards, schema = len(sizes), pa.schema([("hash", pa.binary()), ("doc_id", pa.int64())])
    rounds, size = [[]], 0
    for s in sorted(sizes):
        if rounds[-1] and size + sizes[s] > FILTER_BYTES:
            rounds.append([])
            size = 0
        rounds[-1].append(s)
        size += sizes[s]
    out = None
    for turn in rounds:
        low, high = turn[0], turn[-1]
        table = spark.sparkContext.broadcast([(r.shard, bytes(r.slots), list(r.overflow)) for r in filters.filter(F.col("shard").between(low, high)).collect()])

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            held = {s: CuckooFilter.of(slots, overflow) for s, slots, overflow in table.value}
            for b in batches:
                if not b.num_rows:
                    continue
                keys, shard = _keys(b.column(0).to_pylist()), b.column(2).to_numpy()
                hit = np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    own = order[lo:hi]
                    hit[own] = held[int(shard[own[0]])].contains(keys[own])
                some = b.filter(pa.array(hit))
                yield batch(schema, some.column(0), some.column(1))

        asked = lines.withColumn("shard", _shard(shards)).filter(F.col("shard").between(low, high))
        found = asked.select("hash", "doc_id", "shard").mapInArrow(lean(run), "hash binary, doc_id long")
        out = found if out is None else out.unionByName(found)
    return out


def _gone(docs: DataFrame, min_chars: int, min_docs: int, counts: DataFrame | None, filters: DataFrame | None) -> DataFrame:
    """(doc, gone): the hashes of the lines that each document loses."""
    lines = stored(_hash_rows(docs, min_chars), "lines")
    often = stored(frequent(_counted(lines) if counts is None else counts, min_docs), "frequent-lines")
    filters = stored(filters_of(often) if filters is None else filters, "filters")
    # rows without an id lose nothing
    hits = _hits(lines.filter("doc_id is not null"), filters)
    sure = spread_join(hits, often, ["hash"], "refs").filter("last_doc is not null and doc_id <> last_doc")
    return stored(sure.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("hash").alias("gone")), "dropped-lines")


def kept_lines(text: str, gone, min_chars: int) -> list[bool]:
    """Which lines of a text stay. ``gone``: hashes of lines that don't, or None."""
    lines = text.split("\n")
    if gone is None:
        return [True] * len(lines)
    out = {bytes(h) for h in gone}
    return [len(line) < min_chars or line_hash(line, min_chars) not in out for line in lines]


def kept_text(text: str, stays: list[bool]) -> str:
    return text if all(stays) else "\n".join(line for line, stay in zip(text.split("\n"), stays) if stay)


def _with_gone(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str, str]:
    # what is dropped grows with the documents: never broadcast, at no size
    doc, out = fresh(docs, "_doc"), fresh(docs, "_gone")
    return docs.join(gone.select(F.col("doc").alias(doc), F.col("gone").alias(out)).hint("merge"), F.col("doc_id").cast("long") == F.col(doc), "left"), doc, out


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """Per document the lines before dropping, those dropped, and a digest of the rest.
    ``counts`` and ``filters`` may hold what was made before, of these documents too."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked, _, gone = _with_gone(narrow, _gone(narrow, min_chars, min_docs, counts, filters))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, own in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist()):
                stays = kept_lines(text, own, min_chars)
                kept = kept_text(text, stays).encode("utf-8", "surrogatepass")
                out.append((doc, len(stays), len(stays) - sum(stays), hashlib.sha256(kept).hexdigest()))
            yield batch(schema, *(zip(*out) if out else ([],) * 4))

    return marked.select("doc_id", "text", gone).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """``docs`` whose texts have lost their repeated lines; all columns and rows stay,
    a null text stays null. ``counts`` and ``filters`` as for ``line_digests``."""
    marked, doc, gone = _with_gone(docs, _gone(docs, min_chars, min_docs, counts, filters))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_text(t, kept_lines(t, g, min_chars)) for t, g in zip(texts, gone)], dtype=object)

    return marked.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(without("text", gone))).drop(doc, gone)


ORACLE = """
WITH rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
lines AS (
  SELECT row_id, doc_id, pos, line, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS bare
  FROM (SELECT row_id, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM rows_)),
keyed AS (
  SELECT row_id, doc_id, pos, line, length(bare) AS n,
         translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE n >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT row_id, keyed.doc_id, pos, line, (last_doc IS NOT NULL AND keyed.doc_id IS NOT NULL AND last_doc <> keyed.doc_id) AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k AND n >= 40)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""
