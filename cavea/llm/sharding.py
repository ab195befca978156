"""Proportional stratified interleaving of documents into shards.

Within each source the rows are ranked in a seeded shuffle; row r of n gets the
fractional rank (r - 1/2) / n. Sorted by fractional rank, every stretch of rows has
the mixture of the whole, so equal cuts give shards of the same mixture whose row
counts differ by one at most (law ``rows``).

No ranking needs a source in one task: rows are counted by (source, slice of the
shuffle key), the slices are ranked apart, and running sums of the counts give each
slice its offset. The same is done for the global order.

The number of slices follows the rows, so that each holds ``SLICE_ROWS`` or so.

Defined cases: a null source is a source of its own; a null text has no bytes and
the checksum of nothing; rows of one key are ordered by all their columns, so that a
task that runs again ranks alike; rows without an id get shuffle keys from all their
columns and so go to all slices; rows equal in every column are told apart by a
running number, so each keeps its own slot; texts of any length count by their bytes;
an empty table gives no rows; other columns pass through, also those named as the new
ones are (the new ones then have longer names). Equal texts need not share a shard
under law ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, whole_row

#: Slices of the shuffle key for one source, and cuts of the global order, at least;
#: rows of a slice from which there are more.
SLICES, CUTS, SLICE_ROWS = 256, 4096, 100_000


def shuffle_key(seed: int, *columns: str) -> Column:
    """Hex digest that orders rows at random but always alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))


def slices_for(rows: int, at_least: int) -> int:
    """Slices of a power of two of ``at_least``, so that each has ``SLICE_ROWS`` at most
    or so, however many rows there are."""
    while at_least * SLICE_ROWS < rows:
        at_least *= 2
    return at_least


def key_slice(slices: int) -> Column:
    """Slice of ``_key`` (hex digits), rising with it."""
    return F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * slices / F.lit(float(1 << 32)))


def ranked(df: DataFrame, within: list[str], slice_of: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with the 1-based rank ``out`` of each row within ``within`` by
    (slice, order), and ``out``_of, the rows there. ``slice_of`` must rise with the
    order and be bounded, so that no task holds a whole group."""
    df = df.withColumn("_slice", slice_of)
    keys = [*within, "_slice"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_slice")) - F.col("_n"))
    counts = counts.withColumn(f"{out}_of", F.sum("_n").over(whole)).drop("_n")
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (
        local.join(counts, keys)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_slice", "_before", "_local")
    )


def interleaved(df: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 0, n_shards: int = 40) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (from 0, gapless
    in each shard), named with a further ``_`` where ``df`` has such a column. ``df`` should hold narrow columns only; wide ones are better
    joined afterwards."""
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    ready = df.select(whole_row(df), named.alias("_source"), F.col(key).alias("_id"))
    # rows without an id are dealt by all their columns, so they don't meet in one slice
    row_key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.xxhash64("_row"), F.hash("_row")))
    ready = ready.withColumn("_key", F.when(F.col("_id").isNull(), row_key).otherwise(shuffle_key(seed, "_id")))
    rows = df.count()
    order = [F.col("_key"), F.col("_id"), F.xxhash64("_row"), F.hash("_row")]
    own = ranked(ready, ["_source"], key_slice(slices_for(rows, SLICES)), order, "_rank")
    own = own.withColumn("_part", (2 * F.col("_rank") - 1) / (2 * F.col("_rank_of")))
    tie = [F.col("_part"), F.col("_key"), F.col("_id"), F.col("_source"), F.col("_rank")]
    placed = ranked(own, [], F.floor(F.col("_part") * slices_for(rows, CUTS)), tie, "_place")
    # the first (rows mod n_shards) shards hold one row more than the others
    at, short = F.col("_place") - 1, F.floor(F.col("_place_of") / n_shards)
    more = F.col("_place_of") % n_shards
    edge = more * (short + 1)
    early = at < edge
    shard = F.when(early, F.floor(at / (short + 1))).otherwise(more + F.floor((at - edge) / F.greatest(short, F.lit(1))))
    slot = F.when(early, at % (short + 1)).otherwise((at - edge) % F.greatest(short, F.lit(1)))
    return placed.select("_row.*", shard.cast("int").alias(fresh(df, "shard")), slot.cast("long").alias(fresh(df, "slot")))


def shard_report(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """Every document with its size, checksum, shard and slot under law ``rows``.

    Size is the UTF-8 length of the text plus 16; the checksum is unsigned.
    """
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        (F.length(content) + 16).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"),
    )
    return interleaved(narrow, seed=seed, n_shards=n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
