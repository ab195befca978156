"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree to the
residual of one binned feature and adds it to that feature's lookup table. Then the
pairs of features whose crossed cuts gain most are boosted the same way in two
dimensions. A score is the sum of looked-up values, so scoring is array additions.

The model is fitted on the driver from the features of a bounded sample of labelled
rows (``SAMPLE``); every document is scored whole.

Defined cases: an empty or null text has zero features and the score these give;
without usable labels of both kinds every score is the share of label 1, or 0.5;
labels other than 0 and 1 are ignored; repeated rows and labels count each; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, hashed_words, utf8
from .language import held_out

#: Labelled rows of the sample, about.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 150, 60, 0.1, 20

FEATURES = [
    "log bytes", "log words", "mean word", "distinct words", "commonest word", "distinct pairs", "letters", "capitals", "digits", "non-ASCII",
    "full stops", "commas", "pipes", "other symbols", "log lines", "line length", "short words", "lines without stop",
]

_KIND = np.full(256, 9, np.uint8)  # other symbols
_KIND[[32, *range(9, 14)]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[ord(".")], _KIND[ord(",")], _KIND[ord("|")] = 5, 6, 7


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a chunk."""
    n = len(offsets) - 1
    lo, size = int(offsets[0]), np.diff(offsets)
    raw = data[lo : int(offsets[-1])]
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 10 + _KIND[raw], minlength=n * 10).reshape(n, 10).astype(float)
    newline = raw == 10
    lines = np.bincount(text[newline], minlength=n) + 1
    last = np.concatenate((raw[1:] == 10, [False]))[: len(raw)]
    stopped = np.bincount(text[last & ((raw == 46) | (raw == 33) | (raw == 63)) & ~newline], minlength=n)
    word, length, cut = hashed_words(offsets, data)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate(([0], cut))))
    words = np.bincount(owner, minlength=n)
    long = np.bincount(owner, length, n)
    short = np.bincount(owner[length <= 3], minlength=n)
    kinds_of, most, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    before = 0
    for i, end in enumerate(cut.tolist()):
        own, before = word[before:end], end
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            kinds_of[i], most[i] = len(counts), counts.max()
            pairs[i] = len(np.unique(own[:-1] * np.uint64(3) + own[1:])) / max(1, len(own) - 1)
    some, all_of = np.maximum(words, 1), np.maximum(size, 1)
    share = kinds / all_of[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(words), long / some, kinds_of / some, most / some, pairs, share[:, 1] + share[:, 2] + share[:, 4], share[:, 2], share[:, 3],
        share[:, 4], kinds[:, 5] / some, kinds[:, 6] / some, kinds[:, 7] / some, share[:, 9], np.log1p(lines), np.log1p(size / lines), short / some,
        1 - np.minimum(stopped + 1, lines) / lines,
    ])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of that depth on one feature's sums."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    value = np.full(len(g), cg[-1] / (ch[-1] + 1.0))
    if not depth or len(g) < 2:
        return value
    gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    gains[(cn[:-1] < LEAST_ROWS) | (cn[-1] - cn[:-1] < LEAST_ROWS)] = -1
    cut = int(gains.argmax()) + 1
    if gains[cut - 1] <= _gain(cg[-1], ch[-1]):
        return value
    return np.concatenate((_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best crossed cut of a grid: its gain and the values of the four quarters."""
    best, values = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    whole = cg[-1, -1], ch[-1, -1]
    a = cg[:-1, :-1], ch[:-1, :-1]
    b = cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1]
    c = cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1]
    d = whole[0] - a[0] - b[0] - c[0], whole[1] - a[1] - b[1] - c[1]
    gains = sum(_gain(*x) for x in (a, b, c, d))
    if gains.size:
        i, j = np.unravel_index(gains.argmax(), gains.shape)
        best = float(gains[i, j] - _gain(*whole))
        for part, x in (((slice(None, i + 1), slice(None, j + 1)), a), ((slice(None, i + 1), slice(j + 1, None)), b), ((slice(i + 1, None), slice(None, j + 1)), c), ((slice(i + 1, None), slice(j + 1, None)), d)):
            values[part] = x[0][i, j] / (x[1][i, j] + 1.0)
    return best, values


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return cls()
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        if y.min() == y.max():
            return cls(base=np.log(share / (1 - share)))
        steps, few = np.linspace(0, 1, BINS + 1)[1:-1], np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        m = cls(np.log(share / (1 - share)), [np.unique(np.quantile(v, steps)) for v in x.T], [], [np.unique(np.quantile(v, few)) for v in x.T])
        m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
        bins, score = m._bins(x, m.cuts), np.full(len(y), m.base)
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, m.tables)]

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for b, t, n in zip(bins, m.tables, counts):
                g, h = residual()
                step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), n)
                t += step
                score += step[b]
        grid = m._bins(x, m.coarse)
        g, h = residual()

        def sums(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shape = len(m.coarse[i]) + 1, len(m.coarse[j]) + 1
            cell = grid[i] * shape[1] + grid[j]
            return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_cross(*sums(*p, g, h))[0])
        m.pairs = {p: np.zeros((len(m.coarse[p[0]]) + 1, len(m.coarse[p[1]]) + 1)) for p in ranked[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in m.pairs.items():
                step = RATE * _cross(*sums(i, j, *residual()))[1]
                t += step
                score += step[grid[i], grid[j]]
        return m

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for t, b in zip(self.tables, self._bins(x, self.cuts)):
            total += t[b]
        if self.pairs:
            grid = self._bins(x, self.coarse)
            for (i, j), t in self.pairs.items():
                total += t[grid[i], grid[j]]
        return 1 / (1 + np.exp(-total))


def _chunked(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, stop, features) over stretches of about ``limit`` bytes."""
    offsets, data = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, features(offsets[lo : hi + 1], data)
        lo = hi


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, sample: int = SAMPLE) -> AdditiveModel:
    """Fitted on about ``sample`` labelled rows at most that aren't held out."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(mod, rest))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            for lo, hi, x in _chunked(b.column(1)):
                yield batch(schema, b.column(0).slice(lo, hi - lo), x.tolist())

    # the sample is bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = rows.mapInArrow(run, "y int, x array<double>").toPandas()
    order = np.lexsort(np.array(got["x"].tolist()).T) if len(got) else []  # sums come out alike however rows arrive
    return AdditiveModel.fit(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))[order], got["y"].to_numpy(float)[order])


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def scores(docs: DataFrame, model: AdditiveModel, mod: int = 3, rest: int = 1) -> DataFrame:
    """Score and prediction of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in _chunked(b.column(2)):
                s = model.score(x)
                yield batch(SCORES, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), s, (s >= 0.5).astype(np.int32))

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, rest).alias("held_out"), "text")
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
