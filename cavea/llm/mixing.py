"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a seeded shuffle, form blocks. Served without steps, source s
has min(w * V, n) of its n blocks done at virtual time V, and t(V), their sum over all
sources, is the time in slots: while all sources last, each goes on at its exact
weight; when one runs out, the rest share its weight. Block j is released at
floor(t(j / w)) and due at ceil(t((j + 1) / w)) (floor(j / w) and ceil((j + 1) / w)
at weights that sum to one); slots go to the released block with the earliest
deadline. Then, at every slot, a source's blocks differ from its exact share by less
than one, to the end of the input.

Weights are exact whole numbers, never rounded to a period. The walk over slots holds
one block a source and streams in one task, a step for each block of rows. Every row
gets a place; none is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a given
weight get the mean weight; an empty table gives no rows; repeated rows keep a
place each; rows of one key are ordered by all their columns, so a task that runs
again places them alike; equal deadlines go by the source's name; texts aren't read;
extra columns pass through, also those named as the new ones are (which then have
longer names).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, fresh, stored, whole_row
from .sharding import SLICES, key_slice, ranked, shuffle_key, slices_for

BLOCK_ROWS = 16
#: Slots of so many blocks of a source are one row of the schedule.
CHUNK = 256
#: The schedule is broadcast up to so many blocks (8 bytes each); beyond it is joined.
BROADCAST_BLOCKS = 1_600_000


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole slots of a period, one at least; they sum to the period,
    or to the number of sources if that is larger."""
    period = max(period, len(weights))
    total = sum(weights.values()) or 1.0
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (slots[s] - exact[s], s))
    while (left := period - sum(slots.values())) > 0:
        for s in order[:left]:
            slots[s] += 1
    while sum(slots.values()) > period:
        largest = max(slots, key=lambda s: (slots[s], s))
        slots[largest] -= 1
    return slots


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers in exactly the same proportions."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*[x.denominator for x in parts.values()]) if parts else 1
    return {s: int(x * unit) for s, x in parts.items()}


def walk(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of all blocks, slot by slot, by earliest deadline among
    the released; ``weights`` are positive whole numbers."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    n, w = [blocks[s] for s in names], [weights[s] for s in names]
    order = sorted(range(len(names)), key=lambda i: Fraction(n[i], w[i]))
    # before the k-th source runs out: blocks of those that did, weight of the rest
    gone, rest = [0], [sum(w)]
    for i in order:
        gone.append(gone[-1] + n[i])
        rest.append(rest[-1] - w[i])

    def times(i: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of the time when j blocks of source i are due."""
        low, high = 0, len(order)
        while low < high:
            mid = (low + high) // 2
            if n[order[mid]] * w[i] < j * w[order[mid]]:
                low = mid + 1
            else:
                high = mid
        whole = gone[low] * w[i] + rest[low] * j
        return whole // w[i], -(-whole // w[i])

    waiting, ready = [], []
    for i in range(len(names)):
        heappush(waiting, (0, times(i, 1), i, 0))
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            _, (after, due), i, j = heappop(waiting)
            heappush(ready, (due, i, j, after))
        _, i, j, after = heappop(ready)
        yield names[i], j, slot
        if j + 1 < n[i]:
            heappush(waiting, (after, times(i, j + 2), i, j + 1))


def pfair(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) of one period of whole slots."""
    return list(walk(slots, slots))


def schedule(docs: DataFrame, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(_source, _chunk, _slots): slots of ``CHUNK`` blocks of a source in order."""
    schema = pa.schema([("_source", pa.string()), ("_chunk", pa.int64()), ("_slots", pa.list_(pa.int64()))])
    whole = exact(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if not one.num_rows:
                continue
            open_, out = {s: [] for s in blocks}, []
            for s, j, slot in walk(blocks, whole):
                open_[s].append(slot)
                if len(open_[s]) == CHUNK or j + 1 == blocks[s]:
                    out.append((s, j // CHUNK, open_[s]))
                    open_[s] = []
                if len(out) == 1000:
                    yield batch(schema, *zip(*out))
                    out = []
            if out:
                yield batch(schema, *zip(*out))

    return docs.sparkSession.range(1, numPartitions=1).mapInArrow(run, "_source string, _chunk long, _slots array<long>")


def natural_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Counts raised to a power under one: large sources weigh less than their size."""
    return {s: float(n) ** power for s, n in counts.items()}


def _placed(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", key: str = "doc_id", seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_row, _slot, _pos) of each row."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    ready = docs.select(whole_row(docs), shuffle_key(seed, key).alias("_key"), name.alias("_source"), F.col(key).alias("_id"))
    counts = {r[0]: r[1] for r in ready.groupBy("_source").count().collect()}  # one row a source
    if weights is None:
        target = natural_weights(counts)
    else:
        given = {"null" if s is None else "=" + s: w for s, w in weights.items()}
        mean = sum(given.values()) / max(1, len(given)) or 1.0
        target = {s: max(given.get(s, mean), 1e-9) for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    table = stored(schedule(docs, blocks, target), "schedule")
    sent = F.broadcast if sum(blocks.values()) <= BROADCAST_BLOCKS else lambda df: df
    order = [F.col("_key"), F.col("_id"), F.xxhash64("_row"), F.hash("_row")]
    own = ranked(ready, ["_source"], key_slice(slices_for(sum(counts.values()), SLICES)), order, "_rank")
    own = own.withColumn("_block", F.floor((F.col("_rank") - 1) / block_rows))
    own = own.withColumns({"_chunk": F.floor(F.col("_block") / CHUNK), "_j": (F.col("_block") % CHUNK + 1).cast("int")})
    placed = own.join(sent(table), ["_source", "_chunk"])
    slot = F.element_at("_slots", F.col("_j"))
    return placed.select("_row", slot.alias("_slot"), (slot * block_rows + (F.col("_rank") - 1) % block_rows).alias("_pos"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, **settings) -> DataFrame:
    """``docs`` (narrow columns best) with ``mix_slot``, the slot of the row's block,
    and ``mix_pos``, which orders all rows; the target weights default to the square
    root of each source's rows."""
    return _placed(docs, weights, **settings).select("_row.*", F.col("_slot").alias(fresh(docs, "mix_slot")), F.col("_pos").alias(fresh(docs, "mix_pos")))


def mix_report(docs: DataFrame) -> DataFrame:
    """Every document's source and place in the mixture."""
    return mixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"))


def in_mix_order(docs: DataFrame) -> DataFrame:
    """``docs`` sorted by their place in the mixture; all rows and columns stay."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _placed(docs).repartitionByRange(parts, "_pos").sortWithinPartitions("_pos").select("_row.*")
