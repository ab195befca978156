"""Document fingerprints from improbable byte windows.

Every window of ``WINDOW`` bytes has a normalised entropy; the farther that lies from
what prose has, the more improbable the window. A window that is the most improbable
of its neighbourhood often enough is a feature. Features, in order, fill a chain of
Bloom filters; two chains are compared filter by filter by the overlap of their bits
beyond chance, from 0 to 1.

Defined cases: a null text is empty; two empty fingerprints have likeness 1, an empty
and another 0; a text shorter than a window is one feature; equal texts have equal
fingerprints; documents with one id follow each other by the hash of their text; a
lone document is its own next; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, mix64, parts_for

WINDOW = 32
NEIGHBOURHOOD = 32
#: A feature wins so many neighbourhoods at least.
WINS = 8
#: Usual entropy of prose windows, and the least that is no mere filling, of 1000.
USUAL, LEAST = 760, 150
BITS, HASHES, PER_FILTER = 1024, 5, 64

U = np.uint64
_SHIFT = 20
_COUNTS = np.arange(WINDOW + 1, dtype=float)
_TERM = np.concatenate(([0], np.round(_COUNTS[1:] * np.log2(_COUNTS[1:]) * (1 << _SHIFT)))).astype(np.int64)
_GAIN = np.concatenate(([0], np.diff(_TERM)))
_FULL = int(_TERM[WINDOW])
_WEIGHT = mix64(np.arange(1, WINDOW + 1, dtype=U)) | U(1)
_FAR = np.iinfo(np.int64).max


def entropies(raw: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Normalised entropy (0 to 1000) of the window that ends at each byte. ``place``
    are positions in which texts lie at least a window apart; whole-number sums make
    it independent of what else is in the batch."""
    order = np.argsort(raw, kind="stable")
    key = raw[order].astype(np.int64) * (int(place[-1]) + 4 * WINDOW) + place[order]
    at = np.arange(len(raw))
    back, forth = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
    back[order] = at - np.searchsorted(key, key - (WINDOW - 1)) + 1
    forth[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - at
    gain, loss = np.cumsum(_GAIN[back]), np.cumsum(_GAIN[forth])
    text = np.repeat(np.arange(len(first)), length)
    start = first[text]
    inside = at - start >= WINDOW
    total = gain - (gain[start] - _GAIN[back[start]])
    gone = at - WINDOW
    total[inside] -= (loss[gone[inside]] - (loss[start] - _GAIN[forth[start]])[inside])
    return 1000 - total * 1000 // _FULL


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Feature hashes of each text, in order of their places."""
    length = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out: list[np.ndarray] = [np.zeros(0, U)] * len(texts)
    if not len(raw):
        return out
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    gap = 2 * WINDOW
    shift = np.repeat(np.arange(len(texts)) * gap, length)
    at = np.arange(len(raw))
    held = length > 0
    level = entropies(raw, at + shift, np.minimum(first, len(raw) - 1), length)
    # windows by their first byte, in the spread-out positions
    whole = np.full(len(raw) + len(texts) * gap + NEIGHBOURHOOD, _FAR)
    ends = at[at - np.repeat(first, length) >= WINDOW - 1]
    starts = ends - (WINDOW - 1)
    spot = starts + shift[starts]
    rank = np.where(level[ends] < LEAST, 2000, 1000 - np.abs(level[ends] - USUAL))
    whole[spot] = (rank << 40) + spot
    least, span = whole, 1
    while span < NEIGHBOURHOOD:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    windows = length - WINDOW + 1
    hoods = np.where(windows > 0, np.maximum(windows - NEIGHBOURHOOD + 1, 1), 0)
    begin = first + np.arange(len(texts)) * gap
    hood = np.arange(int(hoods.sum())) + np.repeat(begin - np.concatenate(([0], np.cumsum(hoods)[:-1])), hoods)
    won, wins = np.unique(least[hood] & ((1 << 40) - 1), return_counts=True)
    of = np.searchsorted(begin, won, "right") - 1
    good = (wins >= WINS) & (whole[won] >> 40 < 2000)
    some = np.bincount(of[good], minlength=len(texts)) > 0
    best = np.lexsort((won, -wins, of))
    lead = best[np.concatenate(([True], of[best][1:] != of[best][:-1]))] if len(best) else best
    good[lead] |= ~some[of[lead]]
    won, of = won[good], of[good]
    byte = won - of * gap
    hashed = mix64((raw[byte[:, None] + np.arange(WINDOW)].astype(U) * _WEIGHT).sum(1, dtype=U)) if len(won) else np.zeros(0, U)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in np.flatnonzero(held).tolist():
        if length[i] < WINDOW:
            out[i] = np.frombuffer(hashlib.blake2b(texts[i], digest_size=8).digest(), U)
        else:
            out[i] = hashed[cut[i] : cut[i + 1]]
    return out


def chains(found: list[np.ndarray]) -> list[np.ndarray]:
    """A chain of Bloom filters (rows of 16 words) for each list of features."""
    n = np.array([-(-len(f) // PER_FILTER) for f in found])
    base = np.concatenate(([0], np.cumsum(n)))
    flat = np.concatenate(found) if found else np.zeros(0, U)
    size = np.array([len(f) for f in found])
    rank = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(flat) else np.zeros(0, np.int64)
    where = (np.repeat(base[:-1], size) + rank // PER_FILTER) * BITS
    bits = np.zeros(int(base[-1]) * BITS, bool)
    for i in range(HASHES):
        bits[where + ((flat >> U(10 * i)) & U(BITS - 1)).astype(np.int64)] = True
    words = np.packbits(bits).view(U).reshape(-1, BITS // 64)
    return [words[a:b] for a, b in zip(base[:-1], base[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two chains beyond chance, from 0 to 1: each filter of the shorter
    chain takes its best match in the other, weighted by its bits."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    own, other = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance = own[i] * other / BITS
        total += own[i] * float(np.clip((both - chance) / np.maximum(np.minimum(own[i], other) - chance, 1e-9), 0, 1).max())
    return total / float(own.sum())


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), U).reshape(-1, BITS // 64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text."""

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        whole = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return pd.Series([encoded(c) for lo, hi in _lots(whole) for c in chains(features(whole[lo:hi]))], dtype=object)

    return docs.withColumn(out, of(F.col(text)))


def _lots(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text), sorted: each part holds a range of ids, then
    as a guest the first row of the next part, so every document meets its next
    within its part. An id of so many rows that several cuts fall on it is cut by its
    texts' hashes. The driver sees one id a part."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ready = ready.withColumns({"at": F.coalesce("doc_id", F.lit(-(1 << 63))), "mark": F.xxhash64("text")})
    parts = parts_for(docs.sparkSession)
    cuts = Counter(int(c) for c in ready.approxQuantile("at", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else Counter()
    part, parts = _part(cuts)
    ready = ready.withColumn("part", part)
    # the first row of each part is the guest of the part before
    firsts = sorted((r.part, r.at) for r in ready.groupBy("part").agg(F.min("at").alias("at")).collect())
    table = docs.sparkSession.createDataFrame([(firsts[i - 1][0], part, at) for i, (part, at) in enumerate(firsts)], "before int, part int, at long")
    lead = ready.join(F.broadcast(table), ["part", "at"]).groupBy("before")
    first = lead.agg(F.min("at").alias("at"), F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.min_by("text", "mark").alias("text"))
    guests = first.withColumnRenamed("before", "part")
    columns = ["part", "guest", "at", "mark", "doc_id", "text"]
    spread = ready.withColumn("guest", F.lit(0)).select(*columns).unionByName(guests.withColumn("guest", F.lit(1)).select(*columns))
    return spread.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "at", "mark").select("part", "guest", "doc_id", "text")


def _part(cuts: Counter) -> tuple[Column, int]:
    """Number of the range between cuts that holds (at, mark), and how many there are; of
    a cut that comes r times, the rows at it are r ranges of the mark."""
    if not cuts:
        return F.lit(0), 1
    known, starts, number = sorted(cuts), [], 1
    for cut in known:
        starts.append(number)
        number += cuts[cut] + (1 if cuts[cut] > 1 else 0)
    array = lambda numbers: F.array(*[F.lit(x) for x in numbers])
    k = F.size(F.filter(array(known), lambda c: c <= F.col("at")))
    own = lambda numbers: F.element_at(array(numbers), F.greatest(k, F.lit(1)))
    times = own([cuts[c] for c in known])
    share = F.floor((F.col("mark").cast("double") / 2.0**64 + 0.5) * times)
    within = F.when(F.col("at") == own(known), F.least(share, times - 1)).when(times > 1, times).otherwise(0)
    return F.when(k == 0, 0).otherwise(own(starts) + within).cast("int"), number


REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last half is replaced
    by the start of the next document, and their likenesses."""

    def report(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``rows``: (doc_id, text, next text)."""
        for lo, hi in _lots([r[1] for r in rows]):
            lot = rows[lo:hi]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in lot]
            edited = [t.encode("utf-8", "surrogatepass") for t in edited]
            # a next text is nearly always the row after; it is described once
            whole, place = [], []
            for i, (_, t, n) in enumerate(lot):
                if i and lot[i - 1][2] is t:
                    place.append(len(whole) - 1)
                else:
                    whole.append(t)
                    place.append(len(whole) - 1)
                whole.append(n)
            made = chains(features([t.encode("utf-8", "surrogatepass") for t in whole] + edited))
            own, after, late = [made[p] for p in place], [made[p + 1] for p in place], made[len(whole) :]
            yield batch(
                REPORT, [r[0] for r in lot], [len(r[1]) for r in lot], [hashlib.sha256(t).hexdigest() for t in edited], [encoded(c) for c in own],
                [encoded(c) for c in late], [likeness(a, b) for a, b in zip(own, late)], [likeness(a, b) for a, b in zip(own, after)],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for its next
        for b in batches:
            ready = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] == row[0] and not held[1]:
                    ready.append((held[2], held[3], row[3]))
                held = row
            if ready:
                yield from report(ready)

    return _neighbours(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
