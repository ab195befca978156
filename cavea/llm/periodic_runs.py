"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are equal), at least
max(``LEAST``, ``TIMES`` * q) long, that no word beside it extends. Periods are searched at
dyadic scales. At the scale of B words, a run of a period from B to 2 B holds a block of B
words (cut at multiples of B) that comes again a period later, in the window that follows
it. The sums of squared differences of a block and its window at all distances at once are
three terms: squares of the block, squares of the window, and twice their correlation by an
exact number-theoretic transform (whole numbers modulo a prime, no rounding). A zero is a
zero mismatch; its distance seeds an extension to both sides over names of dyadic stretches,
which are equal only if the stretches are. So a zero of the modulus alone seeds nothing.

Blocks that can't match are not transformed: one with a word that doesn't come again
within two block lengths, and one whose window lies in a run of a smaller period (what
would be found there repeats that run). Each scale costs n log n at most, and there are
log n scales. A document is one row in one task, which needs no exchange.

Defined cases: a null or empty text has no words and no runs; a null id has a text like
any; repeated rows have equal results; texts are read whole, however long; an empty table
gives no rows; other columns pass through ``collapse_runs``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, lean, strings

LEAST, TIMES = 24, 3
#: Prime of the transform, 15 * 2^27 + 1, and a primitive root.
PRIME, ROOT = 2_013_265_921, 31
#: Numbers of a batch of transforms.
LOT = 1 << 17

_P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _roots(n: int, back: bool) -> list[np.ndarray]:
    """Powers of the root for each level of a transform of n numbers."""
    out, size = [], 2
    while size <= n:
        w = pow(ROOT, (PRIME - 1) // size, PRIME)
        powers = [1]
        for _ in range(size // 2 - 1):
            powers.append(powers[-1] * (pow(w, -1, PRIME) if back else w) % PRIME)
        out.append(np.array(powers, np.uint64))
        size *= 2
    return out


@lru_cache(maxsize=64)
def _reversed_bits(n: int) -> np.ndarray:
    order = np.zeros(1, np.int64)
    while len(order) < n:
        order = np.concatenate((2 * order, 2 * order + 1))
    return order


def transform(rows: np.ndarray, back: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; lengths are powers of two."""
    n = rows.shape[1]
    a = rows[:, _reversed_bits(n)]
    for powers in _roots(n, back):
        half = len(powers)
        pair = a.reshape(len(a), -1, 2, half)
        low, high = pair[:, :, 0], pair[:, :, 1] * powers % _P
        a = np.stack(((low + high) % _P, (low + _P - high) % _P), 2).reshape(len(a), n)
    if back:
        a = a * np.uint64(pow(n, -1, PRIME)) % _P
    return a


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo the prime, of each block and its window at each
    place where it fits."""
    size, places = blocks.shape[1], windows.shape[1] - blocks.shape[1] + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    padded = np.zeros((2, len(blocks), n), np.uint64)
    padded[0, :, :size], padded[1, :, : windows.shape[1]] = blocks[:, ::-1], windows
    both = transform(padded.reshape(-1, n)).reshape(2, len(blocks), n)
    cross = transform(both[0] * both[1] % _P, back=True)[:, size - 1 : size - 1 + places]
    own = (blocks * blocks % _P).sum(1) % _P
    sums = np.concatenate((np.zeros((len(windows), 1), np.uint64), np.cumsum(windows * windows % _P, 1)), 1)
    return (own[:, None] + (sums[:, size:] - sums[:, :-size]) % _P + np.uint64(2) * (_P - cross)) % _P


class Stretches:
    """Names of all stretches of a power of two of words; equal names, equal words."""

    def __init__(self, words: np.ndarray):
        self.names = [words]
        n, size = len(words), 1
        while 2 * size <= n:
            held = self.names[-1]
            pairs = held[:-size] * np.int64(int(held.max()) + 1) + held[size:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and from b on (a < b)."""
        n, length = len(self.names[0]), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, at = self.names[k], b + length
            fits = at + (1 << k) <= n
            at = np.where(fits, at, 0)
            length += (fits & (name[np.where(fits, a + length, 0)] == name[at])).astype(np.int64) << k
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before a and before b (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, at = self.names[k], a - length - (1 << k)
            fits = at >= 0
            at = np.where(fits, at, 0)
            length += (fits & (name[np.where(fits, b - length - (1 << k), 0)] == name[at])).astype(np.int64) << k
        return length


def _reach(runs: list[np.ndarray], n: int) -> np.ndarray:
    """For each place the furthest end of the runs that start there or before."""
    reach = np.zeros(n + 1, np.int64)
    for found in runs:
        np.maximum.at(reach, found[:, 0], found[:, 0] + found[:, 1])
    return np.maximum.accumulate(reach)


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of ``words`` (whole numbers from 0 on), by start
    and period. ``least`` is 8 * ``times`` at least, and ``times`` 3."""
    words, n = np.asarray(words, np.int64), len(words)
    if n < least:
        return np.zeros((0, 3), np.int64)
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the word's next place
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    numbers, stretches, runs = (words % PRIME).astype(np.uint64), None, []
    size, low = 8, 1
    while times * low <= n:
        high = 2 * size - 1  # periods from low to high
        starts = np.arange(0, n - size - low + 1, size)
        if len(starts):
            reach = _reach(runs, n)
            alive = np.maximum.reduceat(again, starts)
            alive[-1] = again[starts[-1] : starts[-1] + size].max()
            starts = starts[(alive <= high) & (reach[starts] < np.minimum(starts + size + high, n))]
        seeds = []
        for lot in np.array_split(starts, min(len(starts), -(-len(starts) * 4 * size // LOT))) if len(starts) else []:
            at = lot[:, None] + np.arange(low, high + size)
            # what is beyond the end equals nothing: places there are left out below
            zero = mismatches(numbers[lot[:, None] + np.arange(size)], numbers[np.minimum(at, n - 1)]) == 0
            row, place = np.nonzero(zero & (lot[:, None] + low + np.arange(zero.shape[1]) + size <= n))
            seeds.append(np.stack((lot[row], low + place), 1))
        seeds = np.concatenate(seeds) if seeds else np.zeros((0, 2), np.int64)
        seeds = seeds[reach[seeds[:, 0]] < seeds[:, 0] + size + seeds[:, 1]] if len(seeds) else seeds
        if len(seeds):
            stretches = stretches or Stretches(words)
            a, q = seeds.T
            left = stretches.behind(a, a + q)
            found = np.stack((a - left, left + stretches.ahead(a, a + q) + q, q), 1)
            found = np.unique(found[found[:, 1] >= np.maximum(least, times * found[:, 2])], axis=0)
            # a stretch inside a run of a smaller period has that period; but for the first
            # scale, a period that divides another is of an earlier one
            for own in [found[found[:, 2] == q] for q in np.unique(found[:, 2])] if low == 1 else [found]:
                own = own[_reach(runs, n)[own[:, 0]] < own[:, 0] + own[:, 1]]
                if len(own):
                    runs.append(own)
        size, low = (2 * size, 2 * size) if low > 1 else (16, 16)
    if not runs:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(runs)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_places(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in no run, or in the first period of all their runs."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(gone[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def edited(words: list[bytes], doc: int | None) -> list[bytes]:
    """``words``, which from some place on repeat their beginning there, for one in ten ids."""
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def run_report(docs: DataFrame, edit=edited) -> DataFrame:
    """Per document (after ``edit`` of its words) the number of runs, the run of the greatest
    exponent, and digests of all runs and of the words that stay when each run keeps its
    first period."""
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                words = edit(text.encode("utf-8", "surrogatepass").split(), doc)
                runs = find_runs(numbered(words))
                told = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                best = min(runs.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                kept = words if best is None else [w for w, stays in zip(words, kept_places(runs, len(words)).tolist()) if stays]
                row = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                out.append((doc, len(runs), *row, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield batch(schema, *zip(*out))

    shape = ", ".join(f"{n} long" for n in names) + ", runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), shape)


def runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each document."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                runs = find_runs(numbered(text.encode("utf-8", "surrogatepass").split()))
                if len(runs):
                    yield batch(schema, pa.array([doc] * len(runs), pa.int64()), *runs.T)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts keep the first period of each run. A text that loses words has
    one space between the rest; all rows and columns stay."""

    @F.pandas_udf("string")
    def collapsed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            runs = find_runs(numbered(words))
            out.append(b" ".join(w for w, stays in zip(words, kept_places(runs, len(words)).tolist()) if stays).decode("utf-8", "surrogatepass") if len(runs) else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", collapsed("text"))
