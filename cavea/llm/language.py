"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily into the longest stretches that occur in the
sample; the language that needs the fewest phrases, each weighted by the bits that
name a place in its sample, wins. Every letter of the samples is a symbol, however
many there are. The automata are flat tables, sparse ones where an alphabet is large,
and blocks of all texts of a batch walk through them side by side.

Defined cases: a null text, an empty one or one without letters is ``und`` with
score 0; case and the kind of non-letters don't matter; ties go to the language
with more sample text, then by name; without any labelled text all is ``und``;
whole texts are read, however long; a row without an id is held out; repeated rows are
predicted each; extra columns aren't read by ``predictions`` and pass through elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, chunks, kept, strings

UNKNOWN = "und"
#: The sample: so many pieces of so many characters for each language, from
#: distinct texts with the smallest hashes.
PIECES = 160
PIECE_CHARS = 300
#: Symbols: padding, non-letter, a letter that no sample has, then each letter of the
#: samples. Tables are full up to so many entries; beyond it, transitions are sparse.
PAD, SPACE, OTHER = 0, 1, 2
FULL = 1 << 23
BLOCK = 256


#: What a document must show to be accepted: times the even share of languages for its
#: score, from so many letters on; and the most letters that no sample has.
FLOOR, FLOOR_LETTERS, FOREIGN = 1.2, 50, 0.5


def held_out(mod: int, rest: int, doc_id: str = "doc_id") -> Column:
    """Rows without an id are held out: nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(True))


def train(docs: DataFrame, usable: Column | None = None, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, list[str]]:
    """The sample by language. At most about twice ``pieces`` pieces a language
    reach the driver, whatever the number of rows. Copies of a text count once, and a
    language of few distinct texts gives them all."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.filter(usable) if usable is not None else rows
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(distinct).collect()}  # one row a language
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * pieces / max(n, 1)))])
    h = F.xxhash64("text")
    chosen = rows.select("lang", h.alias("h"), "text").filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    start = 1 + F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - piece_chars, F.lit(1)))
    got = chosen.select("lang", "h", F.substring("text", start.cast("int"), F.lit(piece_chars)).alias("piece")).dropDuplicates(["lang", "h"]).collect()
    sample: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.h & ((1 << 20) - 1), r.h)):
        own = sample.setdefault(r.lang, [])
        if len(own) < pieces:
            own.append(r.piece)
    return sample


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, the root first."""
    goto, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        state = len(goto)
        goto.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = state
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return goto


@dataclass
class Table:
    """A suffix automaton over the symbols of its own language."""

    own: np.ndarray  # own symbol of each symbol
    first: np.ndarray  # by own symbol: where a new phrase begins
    full: np.ndarray | None  # next state * width, or its complement where a phrase ends
    keys: np.ndarray  # state * width + symbol of each transition, sorted, and its next
    to: np.ndarray

    @classmethod
    def of(cls, symbols: list[int], n_symbols: int, full: int) -> Table:
        used = sorted({s for s in symbols if s > OTHER})
        own = np.full(n_symbols, OTHER, np.int32)
        own[[PAD, SPACE]] = PAD, SPACE
        own[used] = np.arange(len(used)) + OTHER + 1
        width = len(used) + OTHER + 1
        goto = automaton([int(own[s]) if s != OTHER else -1 for s in symbols])
        kind = np.int32 if len(goto) * width < 1 << 31 else np.int64
        edges = sorted((state * width + c, s * width) for state, out in enumerate(goto) for c, s in out.items() if c > 0)
        keys, to = np.array(edges, kind).reshape(-1, 2).T.copy()
        first = np.zeros(width, kind)
        root = keys < width
        first[keys[root]] = to[root]
        if len(goto) * width > full:
            return cls(own, first, None, keys, to)
        table = np.tile(~first, (len(goto), 1))
        table.ravel()[keys] = to
        table[:, PAD] = 0
        return cls(own, first, table.ravel(), keys[:0], to[:0])

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases that end in each lane (a column of symbols)."""
        width, kind = lanes.shape[1], self.first.dtype
        state, ended = np.zeros(width, kind), np.zeros(width, np.int32)
        at, sign = np.empty(width, kind), np.empty(width, kind)
        for row in self.own[lanes]:
            np.add(state, row, out=at)
            if self.full is not None:
                np.take(self.full, at, out=state, mode="clip")
            else:
                i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
                state = np.where(row == PAD, 0, np.where(self.keys[i] == at, self.to[i], ~self.first[row]))
            np.right_shift(state, 8 * kind.itemsize - 1, out=sign)
            np.subtract(ended, sign, out=ended, casting="unsafe")
            np.bitwise_xor(state, sign, out=state)
        return ended


@dataclass
class Parser:
    langs: list[str]
    code: np.ndarray  # symbol of each code point
    tables: list[Table]  # per language
    bits: np.ndarray  # bits of a phrase

    @classmethod
    def of(cls, sample: dict[str, list[str]], full: int = FULL) -> Parser:
        langs = sorted(sample, key=lambda x: (-sum(map(len, sample[x])), x))
        letters = sorted({c for own in sample.values() for t in own for c in t.lower() if c.isalpha()})
        code = np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), OTHER, SPACE).astype(np.int32)
        for k, c in enumerate(letters, OTHER + 1):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    code[ord(form)] = k
        tables, bits = [], []
        for lang in langs:
            symbols = [int(x) for t in sample[lang] for x in [SPACE, *code[codepoints(t)]]]
            tables.append(Table.of(symbols, OTHER + 1 + len(letters), full))
            bits.append(math.log2(len(symbols) + 2))
        return cls(langs, code, tables, np.array(bits))

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of each text, and those of them that no sample has."""
        symbols = self.code[codepoints("".join(texts))]
        ends = np.cumsum([0, *map(len, texts)])
        some, other = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (symbols > SPACE, symbols == OTHER))
        return np.diff(some), np.diff(other)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not texts or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        points = codepoints("".join(texts))
        symbols = self.code[points]
        n = np.array([len(t) for t in texts])
        blocks = np.maximum(1, -(-n // BLOCK))
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        padded = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
        padded[np.arange(len(symbols)) + np.repeat(first * BLOCK - start, n)] = symbols
        lanes = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
        cost = np.zeros((len(self.langs), len(texts)))
        for k, table in enumerate(self.tables):
            cost[k] = np.add.reduceat(table.phrases(lanes), first) * self.bits[k] / np.maximum(n, 1)
        best = cost.argmin(0)
        share = np.exp2(4 * (cost.min(0) - cost)).sum(0)
        held = np.concatenate(([0], np.cumsum(symbols > SPACE)))
        known = held[start + n] > held[start]
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, 1 / share, 0.0)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parser(sample: dict[str, list[str]]) -> Parser:
    """The sample's parser, built once a worker."""
    name = hashlib.md5(repr(sorted(sample.items())).encode()).hexdigest()
    return kept(("parser", name), lambda: Parser.of(sample))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predictions(docs: DataFrame, mod: int = 5, rest: int = 0) -> DataFrame:
    """Language and score of every whole text, learned from the rows that aren't
    held out."""
    sample = train(docs, ~held_out(mod, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(sample)
        for b in batches:
            texts = strings(b.column(2))
            for lo, hi in chunks(texts):
                langs, score = p.predict(texts[lo:hi])
                yield batch(SCHEMA, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), langs, score)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, rest).alias("held_out"), "text")
    return ready.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, sample: dict[str, list[str]], text: str = "text", out: str = "lang_pred") -> DataFrame:
    """``docs`` with the language of each text in ``out``."""

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        p, whole = parser(sample), ["" if t is None else t for t in texts]
        return pd.Series([x for lo, hi in chunks(whole) for x in p.predict(whole[lo:hi])[0]], dtype=object)

    return docs.withColumn(out, language(F.col(text)))


def lettered(text: str = "text") -> Column:
    """Whether a text has a letter, as the parser sees letters."""

    @F.pandas_udf("boolean")
    def has_letter(texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)

    return has_letter(F.col(text))


def accepted(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The documents predicted to be in one of ``languages`` (all that are learned by
    default). Rejected are texts without letters, with mostly letters that no sample
    has, or that fit all languages alike (score under ``FLOOR`` times the even share,
    from ``FLOOR_LETTERS`` letters on). Where no row has a label to learn from, all
    documents with letters stay."""
    sample = train(docs, F.col("lang") != UNKNOWN)
    if not sample:
        return docs.filter(lettered())
    wanted = set(sample if languages is None else languages)

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        p, whole, out = parser(sample), ["" if t is None else t for t in texts], []
        for lo, hi in chunks(whole):
            langs, score = p.predict(whole[lo:hi])
            some, other = p.letters(whole[lo:hi])
            clear = (some < FLOOR_LETTERS) | (score * len(p.langs) >= FLOOR) | (len(p.langs) == 1)
            out += (np.array([lang in wanted for lang in langs], bool) & clear & (other <= FOREIGN * some)).tolist()
        return pd.Series(out, dtype=bool)

    return docs.filter(fits("text"))
