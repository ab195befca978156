"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Words are cut by the public pre-tokenising pattern. Inside a word a segment tree
holds, for each position, the rank of the pair that starts there; its root names
the leftmost pair of the lowest rank. A merge updates at most three leaves, each in
logarithmic time, until no pair has a rank. Many words advance together, a tree to
a lane of arrays; a word of over 64 bytes has a tree of its own. Words recur, so a
bounded table per worker keeps their ids.

Defined cases: a null or empty text has no ids; the special token's own string in
a text becomes its single id, as the public library does by default; very long
words cost n log n; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import batch, chunks, strings

# The pattern by which the public vocabulary was made.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 60
#: Words that share one set of array operations.
LANES = 8192


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else
    the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(free)) for b in range(256)]


class RankTree:
    """Minimum over leaves with the leftmost leaf among ties."""

    def __init__(self, ranks: list[int]):
        self.size = 1
        while self.size < max(1, len(ranks)):
            self.size *= 2
        self.low = [NO_RANK] * self.size + ranks + [NO_RANK] * (self.size - len(ranks))
        for i in range(self.size - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def put(self, leaf: int, rank: int) -> None:
        i = leaf + self.size
        self.low[i] = rank
        while i > 1:
            i //= 2
            least = min(self.low[2 * i], self.low[2 * i + 1])
            if self.low[i] == least:
                break
            self.low[i] = least

    def first(self) -> tuple[int, int]:
        """(rank, leaf) of the leftmost lowest leaf."""
        i = 1
        while i < self.size:
            i *= 2
            if self.low[i] > self.low[i + 1]:
                i += 1
        return self.low[1], i - self.size


class Vocabulary:
    """Merge ranks and tokens of one vocabulary file of the public library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {s: b for b, s in enumerate(byte_symbols())}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in ids.items() if all(c in to_byte for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.byte_id = [ids[s] for s in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        by_key = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.table = tuple(np.array(x, np.int64) for x in zip(*by_key))
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.split = regex.compile(PATTERN).findall
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def word_ids(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, (NO_RANK, -1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = RankTree([merges.get((ids[i], ids[i + 1]), none)[0] for i in range(n - 1)])
        while True:
            rank, i = tree.first()
            if rank == NO_RANK:
                break
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                tree.put(i, merges.get((ids[i], ids[k]), none)[0])
            else:
                tree.put(i, NO_RANK)
            if j < n - 1:
                tree.put(j, NO_RANK)
            if (h := before[i]) >= 0:
                tree.put(h, merges.get((ids[h], ids[i]), none)[0])
        return [i for i in ids if i >= 0]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_RANK where there is none."""
        keys, ranks, made = self.table
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = (keys[at] == want) & (left >= 0) & (right >= 0)
        return np.where(hit, ranks[at], NO_RANK), made[at]

    def many_ids(self, words: list[bytes], size: int) -> list[list[int]]:
        """Ids of words of at most ``size`` bytes, one segment tree a lane. A node
        holds rank * size + leaf, so that the root names the leftmost lowest pair."""
        n = len(words)
        lane, length = np.arange(n), np.array([len(w) for w in words])
        ids = np.full((size + 1, n), -1, np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size).T]
        place = np.arange(size)[:, None]
        ids[:size] = np.where(place < length, flat, -1)
        after = np.minimum(np.broadcast_to(place + 1, (size, n)), size).copy()
        before = np.broadcast_to(place - 1, (size, n)).copy()
        tree = np.full((2 * size, n), NO_RANK, np.int64)
        rank, _ = self._pairs(ids[:size], ids[1:])
        tree[size:] = np.where(rank < NO_RANK, rank * size + place, NO_RANK)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])

        def put(leaf: np.ndarray, of: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[node, of] = value
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[node, of] = np.minimum(tree[2 * node, of], tree[2 * node + 1, of])

        live = lane[tree[1] < NO_RANK]
        while len(live):
            i = tree[1, live] % size
            j = after[i, live]
            k = after[j, live]
            _, made = self._pairs(ids[i, live], ids[j, live])
            ids[i, live], ids[j, live] = made, -1
            after[i, live] = k
            back = k < size
            before[k[back], live[back]] = i[back]
            put(j, live, np.full(len(live), NO_RANK))
            rank, _ = self._pairs(made, ids[k, live])
            put(i, live, np.where(rank < NO_RANK, rank * size + i, NO_RANK))
            h = before[i, live]
            has = h >= 0
            h, of = h[has], live[has]
            rank, _ = self._pairs(ids[h, of], made[has])
            put(h, of, np.where(rank < NO_RANK, rank * size + h, NO_RANK))
            live = live[tree[1, live] < NO_RANK]
        kept = ids[:size].T
        held = kept >= 0
        flat, ends = kept[held].tolist(), np.cumsum(held.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes whole texts. The ids of recent words are kept in two
    generations of at most ``keep`` words each: what is met again moves to the new
    one, and the old one goes when the new is full."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 120_000):
        self.v, self.keep = vocabulary, keep
        self.special = {s: (1, str(i), s) for s, i in vocabulary.special.items()}
        self.seen, self.old = dict(self.special), {}

    def _words(self, text: str) -> list[str]:
        v = self.v
        if v.special_re and any(s in text for s in v.special):
            return [w for span in v.special_re.split(text) for w in ([span] if span in v.special else v.split(span))]
        return v.split(text)

    def _learn(self, words: set[str]) -> dict[str, tuple[int, str, str | bytes]]:
        """Adds the words' ids; returns those too long to keep."""
        v, seen = self.v, self.seen
        longer, words = {}, list(words)
        raw = [w.encode("utf-8", "replace") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        order, least = np.argsort(length, kind="stable"), 0
        for size in (8, 16, 32, 64):
            some = order[(length[order] > least) & (length[order] <= size)].tolist()
            least = size
            for lo in range(0, len(some), LANES):
                lanes = some[lo : lo + LANES]
                for i, ids in zip(lanes, v.many_ids([raw[i] for i in lanes], size)):
                    seen[words[i]] = self._entry(ids, words[i])
        for i in order[length[order] > least].tolist():
            longer[words[i]] = self._entry(v.word_ids(raw[i]), words[i])
        return longer

    def _entry(self, ids: list[int], word: str) -> tuple[int, str, str | bytes]:
        back = b"".join([self.v.bytes_of[i] for i in ids])
        named = ",".join([self.v.name_of[i] for i in ids])
        try:
            text = back.decode()
            return len(ids), named, word if text == word else text  # one string in memory, not two
        except UnicodeDecodeError:
            return len(ids), named, back

    def round_trips(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids as decimals joined by commas, and the text
        decoded from those ids."""
        words = [self._words(t) for t in texts]
        fresh = set().union(*words).difference(self.seen)
        if len(self.seen) > self.keep:
            self.old, self.seen = self.seen, dict(self.special)
            fresh = set().union(*words).difference(self.seen)
        known = fresh.intersection(self.old)
        self.seen.update((w, self.old[w]) for w in known)
        longer, seen = self._learn(fresh - known), self.seen
        if longer:
            seen = ChainMap(seen, longer)
        out = []
        for own in words:
            if not own:
                out.append((0, "", ""))
                continue
            counts, ids, back = zip(*map(seen.__getitem__, own))
            try:
                text = "".join(back)
            except TypeError:
                text = b"".join(x.encode() if isinstance(x, str) else x for x in back).decode("utf-8", "replace")
            out.append((sum(counts), ",".join(ids), text))
        return out

    def round_trip(self, text: str) -> tuple[int, str, str]:
        return self.round_trips([text])[0]

    def encode(self, text: str) -> list[int]:
        ids = self.round_trip(text)[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary(path))
    return _codecs[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the array of ids of each whole text."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(path)
        return texts.map(lambda t: c.encode(t or ""))

    return docs.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text that the ids stand for."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def texts(rows):
        c = codec(path)
        return rows.map(lambda x: c.decode(x if x is not None else []))

    return df.withColumn(out, texts(F.col(ids)))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per document the number of ids and digests of ids and of the text decoded
    from them, and ``extra`` columns; one pass, no exchange."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches:
            texts = strings(b.column(1))
            schema = pa.schema([*DIGEST, *list(b.schema)[2:]])
            for lo, hi in chunks(texts):
                done = c.round_trips(texts[lo:hi])
                yield batch(
                    schema, b.column(0).slice(lo, hi - lo), [n for n, _, _ in done],
                    [sha(i.encode()).hexdigest() for _, i, _ in done], [sha(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in done],
                    *[x.slice(lo, hi - lo) for x in b.columns[2:]],
                )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *extra)
    out = T.StructType.fromDDL("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return kept.mapInArrow(run, T.StructType([*out.fields, *kept.schema.fields[2:]]))
