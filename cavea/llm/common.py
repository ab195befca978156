"""Helpers shared by the operators: tables, shared storage and text arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import reachable

#: Python workers take so many UTF-8 bytes of text at a time; bounds their memory.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Python workers get fewer rows at a time than by default, as rows are texts, and
    find this package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder
    is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("cavea.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cavea-")
        spark.conf.set("cavea.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there
    and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Asks for a collection of garbage, with which Spark deletes the files of exchanges
    that nothing reads any more; else they stay until the driver happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_kept: dict = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(key: object, build) -> object:
    """``build()``, made once for ``key`` in a Python worker. A worker keeps one such
    object, whichever operator made it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Frees what an earlier operator has left in a reused worker, and hands the freed
    memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run):
    """``run`` (of batches) in a worker that starts and ends with little memory."""

    def lighter(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return lighter


def parts_for(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for an explicit exchange: the session's setting."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns added beside it can't clash."""
    return F.struct(*own_columns(df)).alias("_row")


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(start, stop) runs of about ``limit`` characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 64
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def strings(column) -> list:
    """An Arrow string column as a list with '' for null."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, null as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None. At most
    ``limit + 1`` rows ever reach the driver."""
    got = df.limit(limit + 1).collect()
    return got if len(got) <= limit else None


#: Rows of one key from which it is hot, and hot keys that may be broadcast.
HOT_ROWS, HOT_KEYS = 512, 100_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key; null where it has none).
    ``weight`` in ``right`` tells how many rows of ``left`` have the key: hot keys are
    broadcast, so that none of them lands in one task. Where over ``HOT_KEYS`` keys
    are hot, each is a small share, and all are joined by shuffle. Keys aren't null.
    """
    hot = small_rows(right.filter(F.col(weight) > HOT_ROWS), HOT_KEYS)
    if not hot:
        return left.join(right, on, "left")
    table = F.broadcast(left.sparkSession.createDataFrame(hot, right.schema))
    rest = left.join(table.select(*on), on, "left_anti").join(right.filter(F.col(weight) <= HOT_ROWS), on, "left")
    return left.join(table, on).unionByName(rest)


#: Keys up to which a sieve is broadcast, and its bits for each.
SIEVE_KEYS, SIEVE_BITS = 1 << 25, 16
_PAGE = 1 << 15


def sifted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``df`` whose ``key``, a hash, may be one of ``keys``, all others). ``keys``
    has one column h of such hashes. A bitmap of 16 bits a key (64 MB at most) is broadcast,
    so neither part takes an exchange; with more keys all rows may be one of them."""
    n = keys.count()
    if n > SIEVE_KEYS:
        return df, None
    bits = max(_PAGE, 1 << (SIEVE_BITS * n - 1).bit_length())
    page, bit, bitmap = (fresh(df, c) for c in ("_page", "_bit", "_bitmap"))
    place = lambda h: F.pmod(h, F.lit(bits))
    pages = keys.select(F.shiftright(place(F.col("h")), 15).alias(page), (place(F.col("h")) % _PAGE).alias(bit))
    pages = stored(pages.groupBy(page).agg(F.bitmap_construct_agg(bit).alias(bitmap)), "sieve")
    own = [*own_columns(df), F.shiftright(place(key), 15).alias(page), (place(key) % _PAGE).cast("int").alias(bit)]
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, F.col(bit) % 8) == 1, F.lit(False))
    rows = df.select(*own).join(F.broadcast(pages), page, "left")
    return rows.filter(met).select(*own_columns(df)), rows.filter(~met).select(*own_columns(df))


def odd_weights(n: int, start: int = 1) -> np.ndarray:
    return mix64(np.arange(start, start + n, dtype=np.uint64)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ROW = [odd_weights(1 << 12)]


def hashed_words(offsets: np.ndarray, data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte length of every word of a chunk of texts (stretches between
    ASCII white space, A-Z in lower case if ``fold``), and each text's end among them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    n = len(offsets) - 1
    raw = np.empty(hi - lo + n, np.uint8)  # a space ends each text
    at = np.arange(hi - lo) + np.repeat(np.arange(n), np.diff(offsets))
    raw[at] = data[lo:hi]
    ends = offsets[1:] - lo + np.arange(n)
    raw[ends] = 32
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), stop - first, np.zeros(n, np.int64)
    length = stop - first
    if int(length.max()) > len(_ROW[0]):
        _ROW[0] = odd_weights(int(length.max()))
    held = ~space
    place = np.arange(len(raw))[held] - np.repeat(first, length)
    terms = ((_FOLD[raw[held]] if fold else raw[held]).astype(np.uint64) + np.uint64(1)) * _ROW[0][place]
    word = mix64(np.add.reduceat(terms, np.concatenate(([0], np.cumsum(length)[:-1]))) + length.astype(np.uint64))
    cut = np.searchsorted(first, ends)
    return word, length, cut
