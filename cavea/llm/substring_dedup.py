"""Removal of passages that an earlier document has, by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window over it
also starts in a document with a smaller id.

* **Anchors.** A window's anchor is its least run of ``GRAM`` words by hash, so equal
  windows have equal anchors, and one anchor serves some five windows. One exchange of
  anchors tells those found in several documents; only windows over these go on.
* **Reference shards.** A repeated anchor with the words about it, as far as its windows
  reach, is a segment. Segments are dealt by anchor, so that a shard holds all there is
  to match its windows. A suffix automaton over a shard's distinct segments, whose states
  know the least document they end in, is the reference; the segments stream over it, and
  the state of a window's length tells the first document that has it. An automaton takes
  whole anchors; one of more segments than an automaton grows by a word at a time, so that
  its windows are told apart and equal ones still meet. A broadcast of all automata to all
  documents would grow with the square of the corpus; here an automaton meets just the
  segments that can match.
* **Common passages.** Windows in at least one of ``COMMON`` documents of a bounded sample
  (``SAMPLE_DOCS``) are at most a few per cent of the sample's words. Their first documents
  are sums over the whole corpus and travel to all tasks, so that no shard holds them.
  Anchors that are common come last in the order of hashes; a window with none but such is
  its own key.

All documents, windows and words count; the sample decides only by which way a window
goes. Texts travel once, to their marks, and are used again for the result.

Defined cases: a null or empty text has no words; a row without an id keeps its words and
takes none from others; rows of one id don't take from each other, each by its own text;
repeated rows are alike; a text under ``WINDOW`` words keeps all; texts are read whole,
however long; an empty table gives no rows; other columns pass through ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batch, chunks, fresh, hashed_words, lean, mix64, odd_weights, own_columns, parts_for, strings, utf8

WINDOW, GRAM = 13, 5
#: Documents of the sample, and the share (one of so many, eight at least) in which a window or run of words is common.
SAMPLE_DOCS, COMMON = 4096, 512
#: Bytes of text for each task of an exchange; distinct segments of one automaton.
PART_BYTES, SHARD_SEGMENTS = 16 << 20, 4096
#: Bytes of a word's hash that segments carry.
WORD_BYTES = 6
NEVER = np.iinfo(np.int64).max

_NONE = np.zeros(0, np.uint64)


def _hash(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    if len(words) < n:
        return _NONE
    weights = odd_weights(n, seed)
    total = words[: len(words) - n + 1] * weights[0]
    for k in range(1, n):
        total += words[k : len(words) - n + 1 + k] * weights[k]
    return mix64(total)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


class Windows:
    """The windows of a chunk of texts: ``at`` (first word), ``doc`` (its text), ``own``
    (hash), ``anchor`` (first word of its anchor), ``alone`` (its anchor is common)."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, window: int, gram: int, common_grams: np.ndarray = _NONE):
        self.words, _, self.ends = hashed_words(offsets, data, fold=False)
        n = len(self.words)
        lengths = np.diff(self.ends, prepend=0)
        self.first = self.ends - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        whole = np.arange(n) + window <= self.ends[doc]
        self.at = np.flatnonzero(whole)
        self.doc = doc[self.at]
        self.grams = _hash(self.words, gram, 1)
        self.own = _hash(self.words, window, 101)[self.at] if len(self.at) else _NONE
        if not len(self.at):
            self.anchor, self.alone = self.at, np.zeros(0, bool)
            return
        order = (self.grams >> np.uint64(1)) | (_member(self.grams, common_grams).astype(np.uint64) << np.uint64(63))
        least, place = order[self.at], np.zeros(len(self.at), np.int64)
        for k in range(1, window - gram + 1):
            ahead = order[self.at + k]
            less = ahead < least
            least[less], place[less] = ahead[less], k
        self.anchor, self.alone = self.at + place, least >> np.uint64(63) > 0


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, offsets, bytes) of chunks of the column ``text``."""
    column = b.column("text")
    for lo, hi in chunks(strings(column)):
        yield lo, hi, *utf8(column.slice(lo, hi - lo))


def _ids(b: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and which rows have one."""
    column = b.column("doc_id").slice(lo, hi - lo)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def common_passages(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(common windows, first document of each, common runs, mean bytes of a text).

    Hashes of the windows and runs that are common in the sample, sorted. The first
    document is the least of all that have the window."""
    spark, rows = docs.sparkSession, docs.count()
    step = max(1, rows // SAMPLE_DOCS)
    sample = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0))
    size = sample.agg(F.avg(F.octet_length("text"))).first()[0] or 0.0
    schema = pa.schema([("kind", pa.int32()), ("hash", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, offsets, data in _texts(b):
                found = Windows(offsets, data, window, gram)
                for kind, hashes, at in ((0, found.own, found.at), (1, found.grams, np.arange(len(found.grams)))):
                    doc = np.searchsorted(found.ends, at, side="right")
                    hashes = hashes[np.lexsort((hashes, doc))], np.sort(doc)
                    new = np.ones(len(doc), bool)
                    new[1:] = (hashes[0][1:] != hashes[0][:-1]) | (hashes[1][1:] != hashes[1][:-1])
                    one = hashes[0][new].view(np.int64)
                    yield batch(schema, np.full(len(one), kind, np.int32), one)

    least = max(8, min(rows, SAMPLE_DOCS) // COMMON)
    often = sample.select("doc_id", "text").mapInArrow(lean(runs), "kind int, hash long").groupBy("kind", "hash").count().filter(F.col("count") >= least).collect()
    windows, grams = (np.sort(np.array([r["hash"] for r in often if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))
    sent = spark.sparkContext.broadcast(windows)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        least = np.full(len(held), NEVER)
        for b in batches:
            for lo, hi, offsets, data in _texts(b):
                ids, named = _ids(b, lo, hi)
                found = Windows(offsets, data, window, gram)
                on = _member(found.own, held) & named[found.doc]
                np.minimum.at(least, np.searchsorted(held, found.own[on]), ids[found.doc[on]])
        seen = np.flatnonzero(least < NEVER)
        yield batch(pa.schema([("place", pa.int64()), ("doc", pa.int64())]), seen, least[seen])

    first = np.full(len(windows), NEVER)
    if len(windows):
        for r in docs.select("doc_id", "text").mapInArrow(lean(firsts), "place long, doc long").groupBy("place").agg(F.min("doc").alias("doc")).collect():  # a row a common window at most
            first[r["place"]] = r["doc"]
    return windows, first, grams, float(size)


def _dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows) for each part that has rows."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(part[order[lo]]), order[lo:hi]


def repeated_anchors(docs: DataFrame, window: int, gram: int, common, parts: int) -> DataFrame:
    """(doc, anchors): the anchors of each document that other documents have too."""
    packed = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, _, grams, _ = common.value
        for b in batches:
            keys, docs = [], []
            for lo, hi, offsets, data in _texts(b):
                ids, named = _ids(b, lo, hi)
                found = Windows(offsets, data, window, gram, grams)
                on = ~found.alone & named[found.doc] & ~_member(found.own, windows)
                at, where = np.unique(found.anchor[on], return_index=True)
                keys.append(found.grams[at])
                docs.append(ids[found.doc[on][where]])
            keys, docs = np.concatenate(keys or [_NONE]), np.concatenate(docs or [np.zeros(0, np.int64)])
            rows = [(p, keys[own].tobytes(), docs[own].tobytes()) for p, own in _dealt((keys % np.uint64(parts)).astype(np.int64), parts)]
            if rows:
                yield batch(packed, *zip(*rows))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            docs += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        if not keys:
            return
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        cuts = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
        more = np.minimum.reduceat(docs, cuts) != np.maximum.reduceat(docs, cuts)
        on = np.repeat(more, np.diff(np.append(cuts, len(keys))))
        yield from _homeward(docs[on], keys[on].view(np.int64), parts)

    dealt = docs.select("doc_id", "text").mapInArrow(lean(pack), "part int, keys binary, docs binary").repartitionById(parts, F.col("part"))
    return _by_document(dealt.mapInArrow(lean(several), HOMEWARD), np.dtype(np.int64), "anchors", "array<long>", parts)


#: Values of documents, packed by the part to which the documents belong.
HOMEWARD = "part int, docs binary, found binary"


def _homeward(docs: np.ndarray, found: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    home = (mix64(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows = [(p, docs[own].tobytes(), found[own].tobytes()) for p, own in _dealt(home, parts)]
    if rows:
        yield batch(pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("found", pa.binary())]), *zip(*rows))


def _by_document(packed: DataFrame, kind: np.dtype, name: str, shape: str, parts: int) -> DataFrame:
    """(doc, ``name``): all values of each document, as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found = [], []
        for b in batches:
            docs += [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            found += [np.frombuffer(x, kind) for x in b.column(2).to_pylist()]
        if not docs:
            return
        docs, found = np.concatenate(docs), np.concatenate(found)
        order = np.argsort(docs, kind="stable")
        docs, found = docs[order], found[order]
        heads = np.append(np.flatnonzero(np.diff(docs, prepend=~docs[0])), len(docs))
        for lo in range(0, len(heads) - 1, 5_000):
            own = heads[lo : lo + 5_001]
            some = found[own[0] : own[-1]]
            values = pa.array(some) if kind.names is None else pa.StructArray.from_arrays([pa.array(some[n].copy()) for n in kind.names], names=list(kind.names))
            yield pa.RecordBatch.from_arrays([pa.array(docs[own[:-1]]), pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), values)], names=["doc", name])

    return packed.repartitionById(parts, F.col("part")).mapInArrow(lean(run), f"doc long, {name} {shape}")


SEGMENTS = "part int, keys binary, docs binary, tags binary, starts binary, shapes binary, words binary, cut binary"
_SEGMENTS = pa.schema([("part", pa.int32()), *[(n, pa.binary()) for n in ("keys", "docs", "tags", "starts", "shapes", "words", "cut")]])
_CUT = np.dtype([("doc", np.int64), ("tag", np.int32), ("start", np.int32), ("stop", np.int32)])
_OWN = np.dtype([("tag", np.int32), ("start", np.int32), ("stop", np.int32)])


def _spans(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Windows that go, as stretches of words of each text."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + window)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), _CUT)
    if len(first):
        last = np.append(first[1:], len(at)) - 1
        out["doc"], out["tag"], out["start"], out["stop"] = doc[first], tag[first], at[first], at[last] + window
    return out


def segments(marked: DataFrame, window: int, gram: int, common, parts: int) -> DataFrame:
    """Packed by shard: each anchor of several documents with the words about it; and the
    stretches that common windows take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first, grams, _ = common.value
        for b in batches:
            for lo, hi, offsets, data in _texts(b):
                ids, named = _ids(b, lo, hi)
                tags = b.column("tag").slice(lo, hi - lo).to_numpy()
                marks = b.column("anchors").slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), pc.list_value_length(marks).fill_null(0).to_numpy())
                held = np.sort(mix64(marks.flatten().to_numpy().view(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                found = Windows(offsets, data, window, gram, grams)
                usual = _member(found.own, windows)
                where = np.minimum(np.searchsorted(windows, found.own), max(0, len(windows) - 1))
                earlier = first[where] < ids[found.doc] if len(windows) else usual
                gone = np.flatnonzero(usual & named[found.doc] & earlier)
                cut = _spans(ids[found.doc[gone]], tags[found.doc[gone]], (found.at - found.first[found.doc])[gone], window)
                asked = _member(mix64(found.grams[found.anchor] + found.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), held) if len(found.at) else usual
                on = np.flatnonzero(named[found.doc] & ~usual & (found.alone | asked))
                rows = [(p, *[b""] * 6, cut[own].tobytes()) for p, own in _dealt(cut["doc"] % parts, parts)]
                at, anchor, alone, doc = found.at[on], found.anchor[on], found.alone[on], found.doc[on]
                new = np.ones(len(on), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:] | alone[:-1]
                head = np.flatnonzero(new)
                if len(head):
                    tail = np.append(head[1:], len(on)) - 1
                    start, stop, mid, lone = at[head], at[tail] + window, anchor[head], alone[head]
                    key = np.where(lone, found.own[on][head], found.grams[mid])
                    left = np.where(lone, 255, mid - start)
                    count = stop - start - np.where(lone, 0, gram)
                    # words of a segment without those of its anchor
                    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    place += np.repeat(start, count) + np.where(place >= np.repeat(left, count), gram, 0)
                    words = found.words[place].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                    ends, own_doc = np.cumsum(count), doc[head]
                    for p, own in _dealt((key % np.uint64(parts)).astype(np.int64), parts):
                        some = np.concatenate([words[ends[s] - count[s] : ends[s]] for s in own])
                        rows.append((p, key[own].tobytes(), ids[own_doc[own]].tobytes(), tags[own_doc[own]].tobytes(), (start - found.first[own_doc])[own].astype(np.int32).tobytes(), np.stack((left[own], count[own]), 1).astype(np.uint8).tobytes(), some.tobytes(), b""))
                if rows:
                    yield batch(_SEGMENTS, *zip(*rows))

    return marked.mapInArrow(lean(run), SEGMENTS)


class SuffixAutomaton:
    """Suffix automaton of several strings of symbols. ``first`` of a state is the least
    document in which the state's strings end."""

    def __init__(self, strings: list[list[int]], docs: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NEVER]
        for string, doc in zip(strings, docs):
            last = 0
            for symbol in string:
                last = self._extend(last, symbol)
                if doc < self.first[last]:
                    self.first[last] = doc
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.first[state] < self.first[above]:
                self.first[above] = self.first[state]

    def _state(self, length: int, link: int, ahead: dict[int, int]) -> int:
        self.next.append(ahead)
        self.length.append(length)
        self.link.append(link)
        self.first.append(NEVER)
        return len(self.next) - 1

    def _split(self, state: int, below: int, symbol: int) -> int:
        """A state for the strings of ``below`` that end those of ``state`` and ``symbol``."""
        if self.length[below] == self.length[state] + 1:
            return below
        twin = self._state(self.length[state] + 1, self.link[below], self.next[below].copy())
        self.link[below] = twin
        while state >= 0 and self.next[state].get(symbol) == below:
            self.next[state][symbol] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        held = self.next[last].get(symbol)
        if held is not None:
            return self._split(last, held, symbol)
        made = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, self.next[state][symbol], symbol)
        return made

    def firsts(self, string: list[int], n: int) -> list[int]:
        """For each run of ``n`` symbols of ``string`` the least document that has it;
        NEVER where the longest match ending there is shorter."""
        state, matched, out = 0, 0, []
        ahead, link, length = self.next, self.link, self.length
        for k, symbol in enumerate(string):
            while state and symbol not in ahead[state]:
                state = link[state]
                matched = length[state]
            if symbol in ahead[state]:
                state, matched = ahead[state][symbol], matched + 1
            if k + 1 < n:
                continue
            if matched < n:
                out.append(NEVER)
                continue
            while length[link[state]] >= n:
                state = link[state]
                matched = length[state]
            out.append(self.first[state])
        return out


def _longer(held: dict, window: int) -> list[dict]:
    """The segments of one anchor by anchors of a word more: the next word for windows that
    have it, the one before for those that end with the anchor. Equal windows stay together."""
    out: dict = {}
    for string, (doc, lo, hi, uses) in held.items():
        cut = max(0, hi - window + 1)  # the first window with the next word
        pieces = []
        if len(string) - cut >= window:
            pieces.append(((string[lo : hi + 1], 1), string[cut:], lo - cut, hi + 1 - cut, cut))
        if hi >= window:
            at = hi - window
            pieces.append(((string[lo - 1 : hi], 0), string[at:hi], lo - 1 - at, window, at))
        for key, piece, first, stop, skip in pieces:
            same = out.setdefault(key, {}).setdefault(piece, [doc, first, stop, []])
            same[0] = min(same[0], doc)
            same[3] += [(row, k + skip) for row, k in uses]
    return list(out.values())


def _fitting(held: dict, window: int) -> Iterator[dict]:
    """``held`` if one automaton takes it, else by longer anchors, until each fits. An
    anchor of a window's length has one segment."""
    if len(held) <= SHARD_SEGMENTS or all(hi - lo == window for _, lo, hi, _ in held.values()):
        yield held
        return
    for more in _longer(held, window):
        yield from _fitting(more, window)


def _first_documents(texts: list[bytes], docs: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For distinct segments (key, left, words) and their least documents, the first
    document of each of their windows. No two automata share a window."""
    most = window - gram + 1
    out = np.full((len(texts), most), NEVER)
    shard: list = []

    def search() -> None:
        automaton = SuffixAutomaton([string for string, *_ in shard], [doc for _, doc, *_ in shard])
        for string, _, n, uses in shard:
            found = automaton.firsts(string, n)
            for row, k in uses:
                out[row, k : k + len(found)] = found
        shard.clear()

    order = sorted(range(len(texts)), key=texts.__getitem__)
    for (key, lone), rows in groupby(order, key=lambda i: (texts[i][:8], texts[i][8] == 255)):
        n, held = window if lone else most, {}  # symbols to [least document, anchor's start and stop, (row, window) of uses]
        for row in rows:
            left = texts[row][8]
            raw = np.frombuffer(texts[row], np.uint8, offset=9).reshape(-1, WORD_BYTES)
            words = np.zeros((len(raw), 8), np.uint8)
            words[:, :WORD_BYTES] = raw
            string = words.view(np.uint64)[:, 0].tolist()
            if lone:
                held[tuple(string)] = [int(docs[row]), 0, window, [(row, 0)]]
            else:  # the anchor's words are one symbol
                string.insert(left, -1 - int.from_bytes(key, "little"))
                held[tuple(string)] = [int(docs[row]), left, left + 1, [(row, 0)]]
        for part in _fitting(held, n):
            if shard and len(shard) + len(part) > SHARD_SEGMENTS:
                search()
            shard += [(string, doc, n, uses) for string, (doc, _, _, uses) in part.items()]
    if shard:
        search()
    return out


def _cuts(rows: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """(doc, cuts): the stretches that go of each document, from packed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        which, docs, tags, starts, cut = [], [], [], [], []
        for b in batches:
            for keys, doc, tag, start, shape, words, done in zip(*(b.column(n).to_pylist() for n in _SEGMENTS.names[1:])):
                cut.append(np.frombuffer(done, _CUT))
                docs.append(np.frombuffer(doc, np.int64))
                tags.append(np.frombuffer(tag, np.int32))
                starts.append(np.frombuffer(start, np.int32))
                at = 0
                for k in range(len(keys) // 8):
                    n = shape[2 * k + 1] * WORD_BYTES
                    which.append(held.setdefault(keys[8 * k : 8 * k + 8] + shape[2 * k : 2 * k + 1] + words[at : at + n], len(held)))
                    at += n
        if not which and not any(map(len, cut)):
            return
        which, docs, tags, starts = np.array(which, np.int64), np.concatenate(docs), np.concatenate(tags), np.concatenate(starts)
        texts = list(held)
        held.clear()
        least = np.full(len(texts), NEVER)
        np.minimum.at(least, which, docs)
        first = _first_documents(texts, least, window, gram)
        row, k = np.nonzero(first[which] < docs[:, None])
        cut = np.concatenate([*cut, _spans(docs[row], tags[row], starts[row] + k, window)])
        yield from _homeward(cut["doc"].copy(), cut[list(_OWN.names)].astype(_OWN), parts)

    return _by_document(rows.mapInArrow(lean(run), HOMEWARD), _OWN, "_cuts", "array<struct<tag: int, start: int, stop: int>>", parts)


def _with_cuts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with ``cuts``: the stretches of words that
    go, each with the tag of the text it is of."""
    narrow = docs.select("doc_id", "text")
    windows, first, grams, size = common_passages(narrow, window, gram)
    parts = parts_for(docs.sparkSession, int(size * docs.count() / PART_BYTES) + 1)
    common = docs.sparkSession.sparkContext.broadcast((windows, first, grams, size))
    # one exchange of the texts serves both the marks and the result; rows without an id are spread
    home = docs.withColumn("_home", F.coalesce("doc_id", F.xxhash64("text")))
    marks = repeated_anchors(narrow, window, gram, common, parts).withColumnRenamed("doc", "_home")
    marked = home.join(marks.hint("merge"), "_home", "left").select("doc_id", "text", F.hash("text").alias("tag"), "anchors")
    cuts = _cuts(segments(marked, window, gram, common, parts).repartitionById(parts, F.col("part")), window, gram, parts).withColumnRenamed("doc", "_home")
    own = F.filter("_cuts", lambda c: c["tag"] == F.hash("text"))
    found = home.join(cuts.hint("merge"), "_home", "left")
    mine = F.col("doc_id").isNotNull()
    return found.select(*docs.columns, *[F.when(mine, F.transform(own, lambda c: c[n])).alias(f"{n}s") for n in ("start", "stop")])


def kept_words(words: list, starts, stops) -> list:
    """The words that no stretch from a start to a stop covers."""
    if starts is None or not len(starts):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, stops, -1)
    return [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]


def span_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document its words, those removed, and a digest of the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, starts, stops in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = kept_words(words, starts, stops)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield batch(schema, *zip(*out))

    cut = _with_cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, gram)
    return cut.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` whose texts have lost the passages that earlier documents have. A text
    that loses words has one space between the rest; all rows and columns stay."""
    row = fresh(docs, "_row")
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*own_columns(docs)).alias(row))
    cut = _with_cuts(ready, window, gram)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for text, start, stop in zip(texts, starts, stops):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept = kept_words(words, start, stop)
            out.append(text if len(kept) == len(words) else b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(rest("text", "starts", "stops"))
    return cut.withColumn("text", text).select(*[(F.col("text") if c.lower() == "text" else F.col(row).getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
f AS (SELECT seq, min(doc_id) AS first_doc FROM g GROUP BY seq),
gone AS (
  SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f ON g.seq = f.seq AND f.first_doc < g.doc_id),
rest AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.pos) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) p
  LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos WHERE gone.pos IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN rest ON w.doc_id = rest.doc_id
"""
