"""Periodic runs, substring dedup and resampling against brute force, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavea.llm import periodic_runs, resampling, substring_dedup

DOCS = "doc_id long, text string, _home long, part int, hash string, starts int, rank long, _row string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "h", 3, 4, "r") for i, t in rows], DOCS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def naive_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the least period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def smallest_only(runs):
    """Without stretches that have a smaller period as part of a longer run."""
    return [r for r in runs if not any(p < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, p in runs)]


def made_words(rng, kind):
    letters = lambda k, n: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    if kind == 0:
        return letters(rng.randint(1, 3), rng.randint(0, 300))
    out = []
    for _ in range(rng.randint(1, 5)):
        out += letters(8, rng.randint(0, 30))
        unit = letters(rng.randint(1, 8), rng.randint(1, 70))
        reps = rng.uniform(2.5, 6)
        out += (unit * 7)[: int(len(unit) * reps)]
    return out


def test_transform_is_a_convolution():
    rng = np.random.default_rng(3)
    blocks, windows = rng.integers(0, 2**31 - 2**28, (5, 8)).astype(np.uint64), rng.integers(0, 1000, (5, 22)).astype(np.uint64)
    got = periodic_runs.mismatches(blocks, windows)
    for r in range(5):
        for d in range(15):
            assert int(got[r, d]) == sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[r], windows[r, d : d + 8])) % periodic_runs.PRIME
    assert np.array_equal(periodic_runs.transform(periodic_runs.transform(blocks), True), blocks % np.uint64(periodic_runs.PRIME))


def test_runs_are_all_runs():
    rng = random.Random(11)
    for k in range(150):
        words = made_words(rng, k % 4)
        got = periodic_runs.find_runs(np.array([ord(w) for w in words]))
        assert got.tolist() == [list(r) for r in smallest_only(naive_runs(words))], words
    long = ["x"] * 3000 + ["y"] + ["x"] * 9000 + list("abc") * 2000
    assert periodic_runs.find_runs(np.array([ord(w) for w in long])).tolist() == [[0, 3000, 1], [3001, 9000, 1], [12001, 6000, 3]]


def naive_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = smallest_only(naive_runs(words))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    row = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *row, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_report_matches_brute_force(spark, data):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    table = [(i, t) for i, t in table if len((t or "").split()) < 700]
    odd = [(None, "a b " * 30), (3, None), (3, ""), (3, " \n"), (5, "la " * 24), (5, "la " * 24), (6, "la " * 23), (7, "é  é \n" * 40)]
    docs = corpus(spark, table + odd)
    got = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in periodic_runs.run_report(docs).collect())
    want = Counter((i, *naive_report(i, t)) for i, t in table + odd)
    assert got == want and sum(r[1] > 0 for r in want) > 10
    assert periodic_runs.run_report(docs.filter("false")).count() == 0
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.filter("doc_id = 5").collect()} == {"la"}
    assert periodic_runs.runs_of(docs.filter("doc_id = 5")).distinct().collect() == [(5, 0, 24, 1)]


# substring dedup


def naive_spans(table, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in table]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            if i is not None:
                key = tuple(ws[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out[(i, len(ws), len(ws) - len(kept), digest(" ".join(kept)))] += 1
    return out


def spans(docs, **settings):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.span_digests(docs, **settings).collect())


def odd_passages():
    rng = random.Random(7)
    text = lambda n, k: " ".join(rng.choice("abcdefghij"[:k]) for _ in range(n))
    common, rare = " ".join(f"c{k}" for k in range(40)), " ".join(f"r{k}" for k in range(30))
    table = [(i, f"{text(9, 10)} {common if i % 2 else ''}  {text(5, 10)}\n{rare if i in (3, 8) else ''} {text(20, 2)}") for i in range(60)]
    table += [(2, "same id " + common), (2, "same id " + rare), (9, table[9][1]), (9, table[9][1])]
    table += [(None, common), (None, common), (70, None), (71, ""), (72, " \t"), (73, "A " * 13), (74, "a " * 14), (-5, " ".join(f"r{k}" for k in range(5, 25)))]
    table += [(80, text(6000, 10) + common), (81, table[3][1].upper())]
    return table


def test_spans_match_brute_force(spark, data):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert spans(spark.read.parquet(f"{data}/documents.parquet")) == naive_spans(table)
    odd = odd_passages()
    docs = corpus(spark, odd)
    assert spans(docs) == naive_spans(odd)
    assert substring_dedup.span_digests(docs.filter("false")).count() == 0
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd)
    assert Counter((r.doc_id, digest(" ".join((r.text or "").split()))) for r in kept.collect()) == Counter({(i, d): n for (i, _, _, d), n in naive_spans(odd).items()})


def test_every_way_of_a_window_gives_the_same(spark, monkeypatch):
    odd = odd_passages()
    docs, want = corpus(spark, odd), naive_spans(odd)
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 3)
    assert spans(docs) == want
    monkeypatch.setattr(substring_dedup, "COMMON", 1)  # a sample of one document: nothing is common
    monkeypatch.setattr(substring_dedup, "SAMPLE_DOCS", 1)
    assert spans(docs) == want
    real = substring_dedup.common_passages

    def grams_alone(*args):
        windows, first, grams, size = real(*args)
        return windows[:0], first[:0], grams, size

    monkeypatch.undo()
    monkeypatch.setattr(substring_dedup, "common_passages", grams_alone)  # windows of common runs alone are their own keys
    assert spans(docs) == want


def test_automaton_knows_first_documents():
    rng = random.Random(2)
    strings = [[rng.randint(0, 2) for _ in range(rng.randint(0, 15))] for _ in range(30)]
    docs = [rng.randint(0, 99) for _ in strings]
    automaton = substring_dedup.SuffixAutomaton(strings, docs)
    for asked in [*strings, [0, 1, 2, 0, 1, 7, 1, 1, 0]]:
        want = [min([d for s, d in zip(strings, docs) if any(s[j : j + 4] == asked[k : k + 4] for j in range(len(s) - 3))], default=substring_dedup.NEVER) for k in range(len(asked) - 3)]
        assert automaton.firsts(asked, 4) == want


def sharded_segments(rng, anchors, letters, rows):
    """Segments (key, left, words) as an automaton's shard gets them, and their symbols."""
    made = {}
    while len(made) < rows:
        if rng.random() < 0.1:  # a window that is its own key
            words = [rng.randrange(letters) for _ in range(13)]
            key, left, symbols = hash(tuple(words)) % 2**64, 255, words
        else:
            before, after = rng.randint(0, 8), rng.randint(0, 8)
            if before + after < 8:
                continue
            words = [rng.randrange(letters) for _ in range(before + after)]
            key, left = rng.randrange(anchors), before
            symbols = [*words[:before], ("anchor", key), *words[before:]]
        made[key.to_bytes(8, "little") + bytes([left]) + b"".join(w.to_bytes(6, "little") for w in words)] = symbols
    return list(made), list(made.values())


@pytest.mark.parametrize("anchors, letters, rows, limit", [(40, 3, 200, 7), (1, 2, 300, 5), (1, 1, 40, 1), (2, 2, 300, 1), (3, 500, 200, 16), (2, 2, 200, 10_000)])
def test_no_shard_parts_equal_windows(monkeypatch, anchors, letters, rows, limit):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", limit)
    rng = random.Random(anchors * letters + limit)
    texts, strings = sharded_segments(rng, anchors, letters, rows)
    docs = np.array([rng.randint(-9, 99) for _ in texts])
    cuts = [[tuple(s[k : k + n]) for k in range(len(s) - n + 1)] for s, n in ((s, 13 if t[8] == 255 else 9) for t, s in zip(texts, strings))]
    least = {}
    for own, doc in zip(cuts, docs):
        for w in own:
            least[w] = min(least.get(w, doc), doc)
    sizes = []
    real = substring_dedup.SuffixAutomaton

    def counted(strings, docs):
        sizes.append(len(strings))
        return real(strings, docs)

    monkeypatch.setattr(substring_dedup, "SuffixAutomaton", counted)
    got = substring_dedup._first_documents(texts, docs, 13, 5)
    assert [[d for d in row if d != substring_dedup.NEVER] for row in got.tolist()] == [[least[w] for w in own] for own in cuts]
    assert max(sizes) <= limit


def test_anchor_of_more_segments_than_an_automaton_holds(spark):
    def least_run():
        names = [f"k{k}" for k in range(20_004)]
        data = np.frombuffer(" ".join(names).encode(), np.uint8)
        grams = substring_dedup.Windows(np.array([0, len(data)]), data, 13, 5).grams
        return names[int(np.argmin(grams >> np.uint64(1))) :][:5]

    rng, anchor = random.Random(12), least_run()  # nearly all windows over this run have it as their anchor
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    shared = [(fresh(k % 9), fresh(8 - k % 9)) for k in range(3000)]
    text = lambda: " ".join(" ".join([*fresh(12 - len(a)), *a, *anchor, *b, *fresh(12 - len(b))]) for a, b in shared)
    table = [(5, text()), (3, text())]
    want = naive_spans(table)
    assert {(i, n) for i, _, n, _ in want} == {(3, 0), (5, 3000 * 13)}
    assert spans(corpus(spark, table)) == want


def test_anchors_at_the_edge_of_an_automaton(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    shared = [fresh(13) for _ in range(16_000)]
    text = lambda own: " ".join(" ".join([*fresh(4), *passage, *fresh(4)]) for passage in own)
    table = [(i, text(shared[i % 80 :: 80])) for i in range(160)]
    assert spans(corpus(spark, table)) == naive_spans(table)


# resampling


def naive_features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def naive_resampling(table, target):
    raw, aim = Counter(), Counter()
    for _, t in table:
        raw.update(naive_features(t)[1])
    for t in target:
        aim.update(naive_features(t)[1])
    big_s, big_t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (big_s + 10000) / ((raw[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    out, fit = [], []
    for i, t in table:
        words, own = naive_features(t)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        row = [i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words) >= 20:
            fit.append(row)
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k in range(5 * len(fit) // 100):
        fit[k][4] = k + 1
    return Counter(map(tuple, out))


def test_resampling_matches_brute_force(spark, data):
    docs, target = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    table = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    aim = [r.text for r in target.collect()]
    table += [(None, "One two " * 20), (5000, None), (5001, ""), (5002, "Ünï 12 " * 4000), *[(6000, "The same row " * 9)] * 40]
    got = Counter(tuple(r) for r in resampling.resampled(corpus(spark, table), target).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == naive_resampling(table, aim)
    none = resampling.resampled(corpus(spark, []), target.filter("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_parts_are_even_where_all_scores_tie(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RUN_ROWS", 1000)
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(7).cast("long").alias("score"))
    ranked = resampling.ranked(rows)
    got = [(r.doc_id, r.rank) for r in ranked.orderBy("rank").collect()]
    assert [r for _, r in got] == list(range(1, 9001)) and [d for d, _ in got] == [None] * 3000 + sorted(x for x in range(9000) if x % 3)
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and max(sizes) <= 2 * 1000
