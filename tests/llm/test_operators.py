"""Each operator against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cavea.llm import bpe, fingerprint, graph, language, line_dedup, mixing, ngram_join, quality, sharding, site_tree, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, _key string, shard int, sig long"


def corpus(spark, texts, sources=None, langs=None):
    rows = [
        (i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], 0, "p", "k", 7, 9)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(3, 60))) + ".\n" + " ".join(word() for _ in range(20)) for _ in range(25)]
    return [None, "", " \n\t", "ab", "x" * 3000, " ".join(word() for _ in range(4000)), *base, *base[:6], base[0], "Hi <|endoftext|> there", "  z 12 !!"]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, odd_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus(spark, [])


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# fingerprints


def naive_entropy(window):
    return sum(-c / len(window) * math.log2(c / len(window)) for c in Counter(window).values()) / math.log2(len(window)) * 1000


def test_window_entropies_match_their_definition():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (40, 200, 33)]
    raw, length = np.frombuffer(b"".join(texts), np.uint8), np.array([40, 200, 33])
    first = np.array([0, 40, 240])
    level = fingerprint.entropies(raw, np.arange(273) + np.repeat(np.arange(3) * 64, length), first, length)
    for f, t in zip(first, texts):
        for end in range(31, len(t)):
            assert abs(level[f + end] - naive_entropy(t[end - 31 : end + 1])) <= 1


def test_fingerprints_follow_the_text_alone(docs, empty):
    texts = odd_texts()
    got = rows(fingerprint.edit_report(docs))
    assert len(got) == len(texts) and fingerprint.edit_report(empty).count() == 0
    seen = {}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for text, mark in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(text, mark) == mark
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    own = {i: fingerprint.decoded(got[i].fingerprint) for i in got}
    assert fingerprint.likeness(own[5], own[5]) == pytest.approx(1) and fingerprint.likeness(own[0], own[5]) == 0
    assert got[5].near_edited > 0.3 > got[5].near_next


def test_next_document_of_repeated_and_lone_ids(spark):
    one = rows(fingerprint.edit_report(corpus(spark, [(7, "abcd" * 30)])))
    assert one[7].near_edited == pytest.approx(1) and one[7].near_next == pytest.approx(1)
    same = fingerprint.edit_report(corpus(spark, [(3, "aa bb"), (3, "aa bb"), (3, "cc dd"), (None, "ee")]))
    assert same.count() == 4


def test_an_id_of_many_rows_is_cut_by_its_texts(spark):
    """Half of the rows have no id or one id: no part is much larger for it, and each
    document meets its next."""
    table = [(None if i % 4 == 0 else 7 if i % 4 == 1 else 10 + i, f"text {i} " * 3) for i in range(4000)] + [(7, "same")] * 50
    d = corpus(spark, table)
    got = fingerprint._neighbours(d).withColumn("task", F.spark_partition_id()).collect()
    sizes = Counter(r.task for r in got)
    assert max(sizes.values()) < 2 * len(table) / 4 and sum(r.guest for r in got) == len({r.part for r in got})
    marks = {t: m for t, m in d.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(table, key=lambda r: (-(1 << 63) if r[0] is None else r[0], marks[r[1]]))
    after = Counter(zip(order, order[1:] + order[:1]))
    met, held = Counter(), {}
    for r in got:
        before = held.get(r.task)
        if before is not None and before.part == r.part and not before.guest:
            met[(before.doc_id, before.text), (r.doc_id, r.text)] += 1
        held[r.task] = r
    assert met == after


# language


def test_phrases_are_longest_matches():
    sample = {"x": ["the cat sat on the mat and ate the rat"], "y": ["el gato come la rata en la mesa verde"]}
    p = language.Parser.of(sample)
    text = "the rat sat on la mesa and the cat ate"
    source = {k: " " + "".join(v) for k, v in sample.items()}
    ends = {}
    for lang, whole in source.items():
        n, held = 0, ""
        for c in text:
            if held + c in whole:
                held += c
            else:
                n, held = n + 1, c
        ends[lang] = n
    costs = {lang: ends[lang] * p.bits[p.langs.index(lang)] for lang in ends}
    assert p.predict([text])[0] == [min(costs, key=costs.get)] == ["x"]


def test_every_learned_letter_matches():
    # three languages of 400 letters each in one block, far past a byte of symbols
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(1200)]
    words = {f"l{k}": ["".join(rng.choices(letters[k * 400 : k * 400 + 400], k=3)) for _ in range(90)] for k in range(3)}
    words["en"] = ["the", "cat", "sat", "on", "mat", "and", "rat"]
    text = lambda k, n: "  ".join(rng.choices(words[k], k=n))
    sample = {k: [text(k, 60) for _ in range(4 + 3 * i)] for i, k in enumerate(words)}
    asked = [k for k in words for _ in range(5)]
    texts = [text(k, 40) for k in asked] + ["", "7 !"]
    p, sparse = language.Parser.of(sample), language.Parser.of(sample, full=0)
    assert p.predict(texts)[0] == [*asked, "und", "und"]
    assert all(t.full is None for t in sparse.tables) and sparse.predict(texts)[0] == p.predict(texts)[0]
    assert np.array_equal(sparse.predict(texts)[1], p.predict(texts)[1])


def test_language_of_odd_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sample = language.train(docs, ~language.held_out(5, 0))
    p = language.parser(sample)
    langs, score = p.predict(["", "12 34 !", docs.filter("length(text) > 5000").first().text * 30])
    assert langs[:2] == ["und", "und"] and score[0] == 0 and langs[2] != "und"
    got = {r.doc_id: r for r in language.predictions(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark, docs, empty):
    assert {r.lang_pred for r in language.predictions(docs.withColumn("lang", docs.source.substr(9, 0)).filter("false")).collect()} == set()
    assert language.predictions(empty).count() == 0
    assert rows(language.predictions(docs))[0].lang_pred == "und"
    assert language.accepted(docs).columns == docs.columns


def test_copies_of_a_text_teach_their_language_once(spark):
    texts = ["the cat sat on the mat and ate the rat"] * 3000 + ["el gato come la rata en la mesa verde"] * 3
    d = corpus(spark, texts, langs=["en"] * 3000 + ["es"] * 3)
    assert {k: len(v) for k, v in language.train(d).items()} == {"en": 1, "es": 1}
    got = language.predictions(corpus(spark, [(None, "x"), (None, "y")]))
    assert [r.held_out for r in got.collect()] == [True, True]


def test_documents_in_no_learned_language_go(spark):
    en, es = "the cat sat on the mat and ate the rat " * 3, "el gato come la rata en la mesa verde y la casa " * 3
    texts = [en, es, "\u4e00\u4e01\u4e02" * 30, "42 !", None, "cat", en + "\u4e00", "qzx" * 40]
    d = corpus(spark, texts, langs=["en", "es", None, None, None, None, None, None])
    kept = lambda **by: {r.doc_id for r in language.accepted(d, **by).collect()}
    assert kept() - {7} == {0, 1, 5, 6} and kept(languages=["en"]) - {7} == {0, 5, 6}


def naive_prediction(sample, text):
    """Language of a text by greedy longest matches in the joined samples."""
    clean = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    whole = {k: "".join(" " + clean(t) for t in v) for k, v in sample.items()}
    cost = {}
    for lang, source in whole.items():
        n = 0
        for at in range(0, max(1, len(text)), language.BLOCK):
            held = ""
            for c in clean(text[at : at + language.BLOCK]):
                if held + c in source:
                    held += c
                else:
                    n, held = n + 1, c if c in source else ""
        cost[lang] = n * math.log2(len(source) + 2)
    return cost


def test_predictions_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) between 30 and 900 and crc32(cast(doc_id as string)) % 5 <> 1")
    sample = language.train(docs, ~language.held_out(5, 0), 12, 80)
    p = language.Parser.of(sample)
    texts = [r.text for r in docs.limit(25).collect()]
    langs, _ = p.predict(texts)
    for text, lang in zip(texts, langs):
        cost = naive_prediction(sample, text)
        assert cost[lang] == min(cost.values())


def test_lettered_documents_stay_without_labels(spark):
    texts = ["One text", None, "", "12 !", "é", "\u4e00"]
    for d in (corpus(spark, texts, langs=[None] * 6), corpus(spark, texts, langs=[None, "en", "en", None, None, None])):
        got = language.accepted(d)
        assert {r.doc_id for r in got.collect()} == {0, 4, 5} and got.columns == d.columns


# sharding and mixing


def test_rows_without_an_id_go_to_all_slices(spark):
    d = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source")
    )
    cut = sharding.interleaved(d, n_shards=8)
    assert cut.count() == 20000 and cut.select("text").distinct().count() == 20000
    assert [r[1] for r in cut.groupBy("shard").count().orderBy("shard").collect()] == [2500] * 8
    # the fractional ranks of one source are its places, so a spread key mixes both kinds
    none = [r[1] for r in cut.filter("doc_id is null").groupBy("shard").count().collect()]
    assert len(none) == 8 and all(1050 < n < 1450 for n in none)
    again = sharding.interleaved(d.repartition(7), n_shards=8)
    assert cut.exceptAll(again).count() == 0


def test_shards_match_brute_force(spark):
    sources = ["big"] * 61 + ["b"] * 20 + [None] * 9 + ["big"] * 3
    texts = [None, "", "é"] + ["t"] * 87 + [(5, "dup"), (5, "dup"), (5, "dup")]
    got = sharding.shard_report(corpus(spark, texts, sources)).collect()
    assert len(got) == 93
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {2, 3} and set(by) == set(range(40))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 2} == {(18, zlib.crc32("é".encode()))}
    key = lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest()
    ids = [i if not isinstance(t, tuple) else t[0] for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for i, s in zip(ids, sources):
        groups["null" if s is None else "=" + s].append(i)
    order = sorted(((2 * r - 1) / (2 * len(g)), key(i), i, s) for s, g in groups.items() for r, i in enumerate(sorted(g, key=lambda i: (key(i), i)), 1))
    sizes = [len(by[s]) for s in range(40)]
    want = [s for s, n in enumerate(sizes) for _ in range(n)]
    assert sorted((x[2], s) for x, s in zip(order, want)) == sorted((r.doc_id, r.shard) for r in got)


def test_clashing_columns_and_rows_of_one_id(spark):
    rows_ = [(5, "a", f"t{i}", 1, 2, 3, 4) for i in range(40)] + [(5, "a", "t0", 1, 2, 3, 4)] * 3 + [(None, None, None, 1, 2, 3, 4)] * 2
    d = spark.createDataFrame(rows_, "doc_id long, source string, text string, shard int, slot int, mix_slot int, mix_pos int")
    cut = sharding.interleaved(d, n_shards=4)
    assert cut.columns == [*d.columns, "shard_", "slot_"] and len({(r.shard_, r.slot_) for r in cut.collect()}) == 45
    mix = mixing.mixed(d, block_rows=4)
    assert mix.columns == [*d.columns, "mix_slot_", "mix_pos_"] and len({r.mix_pos_ for r in mix.collect()}) == 45
    # however the rows arrive, those of one id get the same places
    places = lambda df: sorted((r.text or "", r.shard_, r.slot_) for r in sharding.interleaved(df, n_shards=4).collect())
    assert places(d) == places(d.repartition(7, "text").sortWithinPartitions(F.desc("text")))


def naive_mix(sources, weights, block_rows):
    """Slot of every row by the plain rule: of the released blocks, the earliest due."""
    names = sorted({"null" if s is None else "=" + s for s in sources})
    blocks = {n: -(-sum(("null" if s is None else "=" + s) == n for s in sources) // block_rows) for n in names}
    w = {n: Fraction(weights[None if n == "null" else n[1:]]) for n in names}

    def when(name, j):
        """Time when j blocks of a source are done, served without steps."""
        v = j / w[name]
        return sum(min(w[n] * v, blocks[n]) for n in names)

    done, out = dict.fromkeys(names, 0), []
    for t in range(sum(blocks.values())):
        free = [n for n in names if done[n] < blocks[n] and math.floor(when(n, done[n])) <= t]
        best = min(free, key=lambda n: (math.ceil(when(n, done[n] + 1)), names.index(n)))
        out.append((best, done[best]))
        done[best] += 1
    return out


def test_mixture_matches_the_plain_rule(spark):
    sources, weights = ["a"] * 90 + ["b"] * 41 + [None] * 23 + ["c"] * 7, {"a": 0.37, "b": 0.33, None: 0.2, "c": 0.1}
    got = mixing.mixed(corpus(spark, ["t"] * len(sources), sources), weights, block_rows=5).collect()
    want = naive_mix(sources, weights, 5)
    slots = {r.mix_slot: "null" if r.source is None else "=" + r.source for r in got}
    assert [slots[t] for t in range(len(want))] == [s for s, _ in want]
    # within a source rows follow the seeded shuffle
    key = lambda i: (hashlib.md5(f"0|{i}".encode()).hexdigest(), i)
    for s in weights:
        own = sorted((r for r in got if r.source == s), key=lambda r: r.mix_pos)
        assert [r.doc_id for r in own] == sorted((r.doc_id for r in own), key=key)


def test_pfair_stays_within_a_block():
    slots = mixing.whole_weights({"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}, 100)
    done = Counter()
    for s, _, t in mixing.pfair(slots):
        done[s] += 1
        for k, a in slots.items():
            assert abs(a / 100 * (t + 1) - done[k]) < 1
    assert dict(done) == slots and sum(mixing.whole_weights({str(i): 1 for i in range(30)}, 7).values()) == 30


def test_mixing_places_every_row(spark, empty):
    sources = ["a"] * 300 + ["b"] * 100 + [None] * 50
    d = corpus(spark, ["t"] * 450, sources)
    got = mixing.mixed(d, {"a": 0.25, "b": 0.5, None: 0.25}, block_rows=5).collect()
    assert len({r.mix_pos for r in got}) == 450 and sorted(r.doc_id for r in got) == list(range(450))
    blocks = {}
    for r in got:
        assert blocks.setdefault(r.mix_slot, r.source) == r.source
    done = Counter()
    for t, slot in enumerate(sorted(blocks)[:38], 1):
        done[blocks[slot]] += 1
        assert all(abs(w * t - done[s]) < 1 for s, w in {"a": 0.25, "b": 0.5, None: 0.25}.items())
    assert mixing.mixed(empty).count() == 0
    ordered = mixing.in_mix_order(d).collect()
    want = [r.doc_id for r in sorted(mixing.mixed(d).collect(), key=lambda r: r.mix_pos)]
    assert [r.doc_id for r in ordered] == want and mixing.in_mix_order(d).columns == d.columns


@pytest.mark.parametrize("n", [3, 1500])
def test_mixture_keeps_exact_weights_to_the_end(n):
    rng = random.Random(n)
    weights = {f"s{i}": rng.random() ** 4 + 1e-5 for i in range(n)}
    blocks = {s: rng.randint(1, 9) if n > 9 else rng.randint(9000, 30000) for s in weights}
    whole, total = mixing.exact(weights), sum(weights.values())
    got = list(mixing.walk(blocks, whole))
    assert [t for *_, t in got] == list(range(sum(blocks.values())))
    assert {(s, j) for s, j, _ in got} == {(s, j) for s, b in blocks.items() for j in range(b)}
    # until the first source runs out, unrounded shares hold within a block
    end = min(b * total / weights[s] for s, b in blocks.items())
    done = Counter()
    for t, (s, j, _) in enumerate(got[: int(end)]):
        assert -1 < weights[s] / total * t - done[s] and weights[s] / total * (t + 1) - done[s] - 1 > -1 - 1e-6
        done[s] += 1
    assert all(abs(weights[s] / total * int(end) - done[s]) < 1 for s in weights)
    # afterwards the others share what is left: no source differs from its share
    at, v = Counter(), 0.0
    for t, (s, j, _) in enumerate(got, 1):
        at[s] += 1
        if t % (len(got) // 7) == 0:
            low, high = 0.0, max(b / weights[x] for x, b in blocks.items())
            for _ in range(100):
                v = (low + high) / 2
                low, high = (v, high) if sum(min(weights[x] * v, blocks[x]) for x in blocks) < t else (low, v)
            assert all(abs(min(weights[x] * v, blocks[x]) - at[x]) < 1 + 1e-6 for x in blocks)


# search


def test_top_products_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 6)).round(2).tolist()
    vectors[40] = vectors[20] = vectors[100] = vectors[7]
    rows_ = [(i, v, 0) for i, v in enumerate(vectors)] + [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (404, [], 0), (440, [1e9] * 6, 0)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, lot int")
    whole = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows_ if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:20]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    ready = topk.integers(df)
    for group, lot in ((32768, 8192), (50, 4)):
        got = topk.search(ready, ready.filter("vec_id % 20 = 0"), group=group, batch_of=lot)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.top_products(df.filter("vec_id = 401")).count() == 0 and topk.top_products(df.filter("vec_id = 20")).count() == 0


def test_pruning_over_groups_skips_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32)) * 3
    vectors = [(i, (centres[i % 12] + rng.normal(size=32) * 0.2).tolist()) for i in range(6000)]
    ready = topk.integers(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    asked = ready.filter("vec_id % 20 = 0")
    told = topk.block_counts(ready, asked, group=1000, batch_of=100).first()
    assert 0 < told.scored < 0.3 * told.blocks
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    m = np.array([whole[i] for i in range(6000)])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(ready, asked, group=1000, batch_of=100).collect()}
    for q in range(0, 6000, 700):
        if q % 20 == 0:
            s = m @ m[q]
            s[q] = -(10**9)
            order = sorted(range(6000), key=lambda i: (-s[i], i))[:20]
            assert [got[q, k] for k in range(1, 21)] == [(i, s[i]) for i in order]


def test_large_components_saturate(spark):
    vectors = [(0, [1e9, 1.0]), (20, [1e9, 2.0]), (21, [-1e300, 0.0]), (22, [1.0, 1.0])]
    got = topk.top_products(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    want = (64 * 10**9) ** 2 + 64 * 128
    assert {(r.query_id, r.vec_id): r.score for r in got.collect()} == {
        (a, b): max(min(s, 2**63 - 1), -(2**63)) for a, b, s in ((0, 20, want), (20, 0, want), (0, 21, -(10**40)), (20, 21, -(10**40)), (0, 22, 64**2 * (10**9 + 1)), (20, 22, 64**2 * (10**9 + 2)))
    }
    twice = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    got = topk.top_products(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 3, 4096), (2, 3, 4096)]


def test_blocks_below_the_kth_are_skipped():
    docs = np.repeat(np.arange(0, 4000, 100), 100)[:, None] * np.ones((1, 4), np.int64)
    _, ids, _, scored = topk.best_in_group(np.array([-1]), np.ones((1, 4), np.int64), np.arange(4000), docs, 5, 100)
    assert scored == 1 and sorted(ids) == [3900, 3901, 3902, 3903, 3904]


# quality


def test_quality_on_held_out_labels(spark, data):
    big = data.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = {r.doc_id: r for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(k == r.doc_id and r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert sum(r.predicted == q for r, q in held) >= 0.93 * len(held)


def test_model_is_a_sum_of_tables_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.AdditiveModel.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in m.pairs
    assert quality.AdditiveModel.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.AdditiveModel.fit(x, np.ones(3000)).score(x[:1])[0] > 0.99


def test_quality_of_odd_texts(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (4, 9, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.scores(docs, quality.train(docs, labels)))
    assert len(got) == len(odd_texts()) and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.scores(empty, quality.train(empty, labels)).count() == 0


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- c --><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use</div><article><h1>Title &amp;\n more</h1><p><b>One&nbsp;two<br>three<p>Four <i>five</i> &lt;six&gt;<ul><li>a<li>b</ul>
<script>var t="</p>";</script><form>x<input></form><div class="comments"><p>Nice</div><aside>More</aside></article><footer>&copy;</footer>"""


def test_main_text_of_a_page(spark):
    pages = [(1, "http://a.b/1", PAGE, "h"), (2, "http://a.b/2", None, "h"), (3, None, "", "h"), (4, "x", "plain <text", "h"), (1, "http://a.b/1", PAGE, "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    for limit in (100_000, 0):
        got = rows(site_tree.main_text(df, limit), "page_id")
        assert got[1].text == "Title & more\nOne two three\nFour five <six>\na\nb" and got[1].n_chars == len(got[1].text)
        assert got[2].text == got[3].text == "" and got[4].text == "plain <text"
    assert site_tree.main_text(df).count() == 5 and site_tree.main_text(df.filter("false")).count() == 0


def test_low_entropy_branches_go(spark):
    page = "<body><div class='x'>Same old line</div><section><p>Story {0} of {0}</p><p>and {0}</p></section></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.text for r in site_tree.main_text(df).collect()} == {f"Story {i} of {i}\nand {i}" for i in range(12)}


def site_texts(spark, page, n=12):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i)) for i in range(n)], "page_id long, url string, html string")
    return [r.text for r in site_tree.main_text(df).orderBy("page_id").collect()]


def test_entropy_overrules_names(spark):
    story = "<p>Story {0} of {0}</p>"
    want = [f"Story {i} of {i}" for i in range(12)]
    for page in (
        f"<body class='has-sidebar'><nav>Menu</nav><div>{story}</div><footer>Us</footer></body>",
        f"<div class='no-comments'><div class='x'>Same old line</div>{story}</div>",
        f"<main class='legal'>{story}</main><footer>Page {{0}}</footer>",
        f"<div id='side'><article>{story}</article></div>",
        f"<form>Find<main>{story}</main></form>",
        f"<article><p>Join our club</p></article><section>{story}</section>",
        f"<article>{story}<p class='x'>Join our club</p></article><nav>Menu {{0}}</nav>",
    ):
        assert site_texts(spark, page) == want
    # few pages, or one page over and over: names alone
    assert site_texts(spark, f"<body class='has-sidebar'><article>{story}</article><div class='ad'>Buy</div></body>", 2) == want[:2]
    assert site_texts(spark, "<article>The one page</article><footer>Us</footer>") == ["The one page"] * 12


def test_names_break_ties_of_the_tree(spark):
    story = "<p>Story {0} of {0}</p>"
    rng = random.Random(4)
    talk = ["".join(f"<p>Re {i} {k}</p>" for k in range(1 + rng.randint(0, 9))) for i in range(12)]
    # two containers of both entropies, or an article of one shape beside talk: the article wins
    for page in (f"<article>{story}@</article><section>@</section>", f"<article>{story}</article><div class='comments'>@</div>", f"<article>{story}</article><section>@</section>"):
        df = spark.createDataFrame([(i, f"http://h.org/{i}", page.replace("@", talk[i]).format(i)) for i in range(12)], "page_id long, url string, html string")
        assert all(r.text.startswith(f"Story {r.page_id} of {r.page_id}") and (len(r.text.split("\n")) == 1 or "@</article" in page) for r in site_tree.main_text(df).collect())
    # a layout of one page goes by its names on a host that the tree knows
    pages = [(i, f"http://h.org/{i}", f"<body><div>Story {i}{talk[i]}</div><section>Us</section></body>") for i in range(12)]
    pages.append((12, "http://h.org/12", "<body><center>Menu<article>Odd one</article><b class='ad'>Buy</b></center></body>"))
    got = rows(site_tree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert got[12].text == "Odd one" and got[3].text.startswith("Story 3\n") and "Us" not in got[3].text


def bare(page):
    """A page without the names that mark its parts."""
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page.replace(' class="ad"', ""))


def test_the_tree_tells_parts_without_names(spark, data):
    big = spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet")
    many = site_tree._with_host(big).groupBy("host").count().filter("count >= 8").select("host")
    df = site_tree._with_host(big).join(many, "host", "left_semi")
    want = rows(site_tree.main_text(df), "page_id")
    plain = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in df.collect()], "page_id long, url string, html string")
    got = rows(site_tree.main_text(plain), "page_id")
    assert len(got) > 50 and all(got[k].text == want[k].text for k in want)
    # names don't stand in for the tree: with it emptied, pages with names change too
    emptied = rows(site_tree.main_text(df, judged=site_tree.judged_paths(df).filter("false")), "page_id")
    assert all(emptied[k].text != want[k].text for k in want)
    # without what the tree says, menus and footers stay
    silent = rows(site_tree.main_text(plain, judged=site_tree.judged_paths(plain).filter("false")), "page_id")
    assert all(silent[k].text != want[k].text for k in want)


def test_merged_trees_match_their_definition(spark):
    rng = random.Random(8)
    part = lambda: rng.choice(["<p>a</p>", "<div><p>b</p></div>", f"<p>{rng.random()}</p>", "<ul><li>x<li>x</ul>", "<div class=k>same</div>"])
    pages = [(i, f"http://h{i % 2}/x", "<body>" + "".join(part() for _ in range(rng.randint(0, 4)))) for i in range(30)]
    got = {(r.host, r.path): (r.m, r.shape, r.words) for r in site_tree.tree_nodes(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    shapes, words, name = defaultdict(list), defaultdict(list), {}
    for _, url, source in pages:
        p = site_tree.Page(source)
        below = defaultdict(set)
        for k in range(len(p.label)):
            at = k
            while at >= 0:
                below[at].add(k)
                at = p.parent[at]

        def shape(k):
            out = []
            for c in [c for c in range(len(p.label)) if p.parent[c] == k]:
                if not (p.tag[c] in site_tree.LISTED and out and out[-1] == shape(c)):
                    out.append(shape(c))
            return (p.label[k], *out)

        own = defaultdict(lambda: ([], []))
        for k, path in enumerate(p.path):
            own[path][0].append(shape(k))
            own[path][1].append(tuple(t for t, node in p.blocks if node in below[k]))
        for path, (s, w) in own.items():
            key = url[7:9], path
            shapes[key].append(tuple(s))
            words[key].append(tuple(w))
    entropy = lambda v: sum(-c / len(v) * math.log(c / len(v), len(v)) for c in Counter(v).values())
    want = {k: (len(v), entropy(v), entropy(words[k])) for k, v in shapes.items() if len(v) >= site_tree.PAGES}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 60_000 + "deep", "<a href='x" * 60_000, '<b "' * 60_000 + "end>", "<h1>" * 60_000 + "</p>" * 60_000, "<main>" * 60_000 + "t", "<!-- " * 60_000,
        "<p>x</b>" * 60_000, "<script>" * 60_000, "</script" * 60_000, "<div><p>" * 30_000 + "y", "word " * 400_000, "<" * 200_000, "<p>" + "<li>z" * 60_000,
    ],
)
def test_reading_takes_time_in_proportion(page):
    start = time.perf_counter()
    p = site_tree.Page(page)
    p.merged()
    p.text({})
    assert time.perf_counter() - start < 6


def test_articles_of_the_table(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    got = rows(site_tree.main_text(df), "page_id")
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", inner[1])]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)


# lines


def naive_lines(table):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(list)
    for i, t in table:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    often = {k: max(v) for k, v in holders.items() if len(set(v)) >= 5}
    return {i: [x for x in (t or "").split("\n") if often.get(key(x), i) == i] for i, t in table}


def line_table():
    rng = random.Random(3)
    pool = ["Common line number %d that is surely long enough É" % i for i in range(12)] + ["short"]
    texts = ["\n".join(rng.choice(pool).upper() + rng.choice(["", " ", "\v"]) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    return list(enumerate([None, "", "\n\n", "x" * 5000, *texts]))


@pytest.mark.parametrize("size", [1 << 26, 64])
def test_line_dedup_matches_brute_force(spark, empty, monkeypatch, size):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", size)  # the small size takes a round a shard
    monkeypatch.setattr(line_dedup, "SHARDS", 5)
    monkeypatch.setattr("cavea.llm.common.HOT_ROWS", 7)
    table = line_table()
    d = corpus(spark, table)
    want = naive_lines(table)
    got = rows(line_dedup.line_digests(d))
    kept = rows(line_dedup.drop_lines(d))
    for i, t in table:
        assert got[i].n_lines == len((t or "").split("\n")) and got[i].n_dropped == got[i].n_lines - len(want[i])
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(want[i]).encode()).hexdigest()
        assert kept[i].text == (None if t is None else "\n".join(want[i]))
    assert line_dedup.drop_lines(d).columns == d.columns and line_dedup.line_digests(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0


def test_lines_of_rows_without_ids_and_of_repeated_rows(spark):
    line = "This very line stands in every one of the documents here"
    lone = spark.createDataFrame([(None, f"{line}\n{i}") for i in range(9)], "doc_id long, text string")
    assert {r.text.count(line) for r in line_dedup.drop_lines(lone).collect()} == {1} and {r.n_dropped for r in line_dedup.line_digests(lone).collect()} == {0}
    few = [(None, line), *[(3, line)] * 3, (4, line + "\nx"), (4, line + "\nx")]
    many = [*few, (1, line), (2, line), (9, line + "\ny"), (9, line + "\nz")]
    for table, gone in ((few, 0), (many, 7)):
        docs = spark.createDataFrame(table, "doc_id long, text string")
        got = sorted(map(tuple, line_dedup.line_digests(docs).collect()), key=str)
        assert sum(r[2] for r in got) == gone and sum(line in r.text for r in line_dedup.drop_lines(docs).collect()) == len(table) - gone
        con = duckdb.connect()
        con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        assert sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str) == got


def test_counts_and_filters_are_reversible(spark):
    d = corpus(spark, line_table()).select("doc_id", "text")
    gone, left = d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0")
    state = lambda df: {(bytes(r.hash), r.refs, r.last_doc) for r in df.collect()}
    whole, part = line_dedup.count_lines(d), line_dedup.count_lines(left)
    assert state(line_dedup.insert(part, gone)) == state(whole)
    fewer = line_dedup.delete(whole, gone, left)
    assert state(fewer) == state(part)
    # filters follow the counts both ways, and drop the same lines as fresh ones
    filters = line_dedup.filters_of(line_dedup.frequent(whole))
    after = line_dedup.followed(filters, whole, fewer)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert texts(line_dedup.drop_lines(left, counts=fewer, filters=after)) == texts(line_dedup.drop_lines(left))
    again = line_dedup.followed(after, fewer, whole)
    assert texts(line_dedup.drop_lines(d, counts=whole, filters=again)) == texts(line_dedup.drop_lines(d))
    held = lambda df: {r.shard: sorted(x for x in np.frombuffer(r.slots, np.uint16).tolist() if x) for r in df.collect()}
    assert held(again) == held(filters) != held(after)


def test_cuckoo_filter_keeps_and_forgets():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = line_dedup.CuckooFilter(4000)
    f.insert(keys)
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    one = line_dedup.CuckooFilter(1)
    one.insert(np.full(20, 9, np.uint64))
    one.delete(np.full(19, 9, np.uint64))
    assert one.contains(np.array([9], np.uint64)).all()


# BPE


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    got = rows(bpe.digests(docs))
    for i, t in enumerate(odd_texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_lanes_and_tree_agree():
    v = bpe.Vocabulary(bpe.vocabulary_path())
    rng = random.Random(4)
    words = [bytes(rng.choice(b"theraions \xc3\xa9") for _ in range(rng.randint(1, 16))) for _ in range(300)]
    assert v.many_ids(words, 16) == [v.word_ids(w) for w in words]


# n-gram join


def naive_classes(table, words, percent):
    sets = {}
    for i, t in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_table(seed, n_groups=6, size=12):
    rng = random.Random(seed)
    out = [None, "", "one", "One", "one two", "a b c", "A b  c"]
    for _ in range(n_groups):
        base = ["w%d" % rng.randint(0, 400) for _ in range(rng.choice([4, 8, 12, 25, 60, 200]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "e%d" % rng.randint(0, 3)
            if rng.random() < 0.3:
                w = w[: -rng.randint(1, 3)] or w
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("words,percent,block", [(3, 90, 256), (5, 80, 5)])
def test_ngram_classes_match_brute_force(spark, empty, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    table = near_table(words)
    d = corpus(spark, table)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.classes(d, words, percent).collect()}
    assert got == naive_classes(table, words, percent)
    assert ngram_join.classes(empty, words, percent).count() == 0


def naive_rows(table, words, percent):
    """Per row of a table of any ids: its id, component's least id, and links."""
    whole = naive_classes([(k, t) for k, (_, t) in enumerate(table)], words, percent)
    ids = [i for i, _ in table]
    groups = defaultdict(list)
    for k, (_, c, _) in whole.items():
        groups[c].append(ids[k])
    least = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    return [(ids[k], n, least[c], links) for k, (n, c, links) in whole.items()]


def clashing_table():
    base = " ".join(f"w{k}" for k in range(40))
    near, far = base.replace("w20", "x"), " ".join(f"z{k}" for k in range(30))
    return [(5, base), (5, base), (6, near), (7, base), (9, near), (9, far), (None, base), (None, far + " q"), (None, None), (3, ""), (3, ""), (11, " ".join(f"v{k}" for k in range(20000)))]


def test_rows_of_one_id_are_told_apart(spark):
    table = clashing_table()
    d = corpus(spark, table)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.classes(d, 3, 80).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(naive_rows(table, 3, 80))
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(d, 3, 80).collect()]
    assert order(kept) == order([table[0], table[5], *table[8:]])


def test_wide_buckets_and_large_families(spark, monkeypatch):
    for name, value in (("WIDE", 6), ("BLOCK", 8), ("BLOCKS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr("cavea.llm.common.HOT_ROWS", 4)
    table = near_table(11, 3, 30) + [(1000 + i, "same text in many copies again and again") for i in range(20)]
    d = corpus(spark, table)
    for words, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.classes(d, words, percent).collect()}
        assert got == naive_classes(table, words, percent)


def test_one_of_each_group_stays(spark):
    table = near_table(8, 3)
    d = corpus(spark, table)
    want = {i for i, (_, c, _) in naive_classes(table, 5, 80).items() if c == i}
    kept = ngram_join.one_of_each(d)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == d.columns


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 120))).astype(np.uint64))
        extra = rng.integers(0, 1 << 62, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.06], extra)))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        table = ngram_join.bands(percent, 400)
        sig = []
        for s in (a, b):
            own = next(i for i, (lo, hi) in enumerate(table) if lo <= len(s) <= hi)
            sig.append({x for band in (own, own + 1) if (k := 2 * table[band][1] * (100 - percent) // (100 + percent)) for x in ngram_join.signatures(s, band, k).tolist()})
        assert sig[0] & sig[1]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 199), (199, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 200: 199}


def test_signatures_travel_in_ten_bytes_a_pair():
    rng = np.random.default_rng(3)
    sigs, members = (rng.integers(0, 1 << 64, 5000, np.uint64) for _ in range(2))
    for buckets in (512, 1 << 14):
        packs = list(ngram_join.packed(sigs, members, buckets))
        assert sum(len(p) for _, p in packs) == 10 * len(sigs)
        back = {(b << 40 | a, m) for b, p in packs for a, m in zip(*ngram_join.unpacked(p).tolist())}
        assert back == set(zip((sigs & np.uint64((buckets << 40) - 1)).tolist(), (members & np.uint64((1 << 40) - 1)).tolist()))


def test_shared_signatures_as_counted(spark):
    rng = np.random.default_rng(4)
    sigs, members = rng.integers(0, 900, 4000, np.uint64) << np.uint64(33), rng.integers(0, 50, 4000, np.uint64)
    packs = [p for lo in range(0, 4000, 500) for p in ngram_join.packed(sigs[lo : lo + 500], members[lo : lo + 500], 512)]
    rows = spark.createDataFrame(packs, "bucket int, pack binary").repartition(3, "bucket").sortWithinPartitions("bucket")
    want = defaultdict(set)
    for a, m in zip(sigs.tolist(), members.tolist()):
        want[a].add(m)
    found = ngram_join._shared(rows).collect()
    assert len(found) == len({(r.sig, r.name) for r in found}) and {(r.sig, r.name, r.salts) for r in found} == {(a, m, 1) for a, ms in want.items() if len(ms) > 1 for m in ms}


def test_sieve_parts_rows(spark):
    from cavea.llm.common import sifted

    rows = spark.range(20000).select("id", F.lit("x").alias("_page"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"))
    keys = rows.filter("id % 50 = 1").select(F.xxhash64("k").alias("h"))
    some, others = sifted(rows, F.xxhash64("k"), keys)
    near, far = ({r.id for r in part.collect()} for part in (some, others))
    assert some.columns == rows.columns and not near & far and near | far == set(range(20000))
    assert set(range(1, 20000, 50)) <= near and len(near) < 5000
    assert sifted(rows, F.xxhash64("k"), keys.limit(0))[0].count() == 0
