"""The pipeline's stages and whole against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cavea.llm import bpe, mixing

from .test_operators import naive_classes, naive_lines


def expected(table):
    """doc_id to text after the first three stages."""
    lettered = [(i, t) for i, t in table if any(c.isalpha() for c in t or "")]
    lines = naive_lines(lettered)
    texts = [(i, "\n".join(lines[i])) for i, _ in lettered]
    classes = naive_classes(texts, 5, 80)
    return {i: t for i, t in texts if classes[i][1] == i}


def test_whole_pipeline_matches_brute_force(spark, data):
    from tokenizers import Tokenizer

    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {}
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    for i, t in expected(table).items():
        ids = lib.encode(t, add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want


@pytest.fixture(scope="module")
def odd(spark):
    line = "The same long line stands in every one of these documents."
    rows = [(0, None, "a", None, 1), (1, "", None, None, 1), (2, "12 !", "a", None, 1)]
    rows += [(i, f"{line}\nOnly {i} has this other text with words {' '.join(f'w{i}x{k}' for k in range(8))}", "b" if i % 2 else None, "en", 1) for i in range(3, 12)]
    rows += [(20, rows[-1][1], "a", "en", 1), (20, rows[-1][1], "a", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _gone int")


def test_stages_keep_columns_and_decide(spark, odd):
    accepted = corpus_pipeline.language_id(spark, odd, "")
    assert accepted.columns == odd.columns and {r.doc_id for r in accepted.collect()} == {*range(3, 12), 20}
    lines = corpus_pipeline.dedup_lines(spark, accepted, "")
    held = [r.doc_id for r in lines.collect() if "same long line" in r.text]
    assert lines.columns == odd.columns and held == [20, 20]
    kept = corpus_pipeline.near_duplicates(spark, accepted, "")
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set(range(3, 12))
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in mixing.mixed(kept).orderBy("mix_pos").collect()] and mixed.columns == odd.columns
    assert corpus_pipeline.encode(spark, mixed, "").count() == 9


def test_the_place_in_the_mixture_reaches_the_end(spark, odd, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, odd.filter("doc_id < 20"), "")
    mixed.write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").orderBy("mix_file", "mix_row")
    assert [r.doc_id for r in got.collect()] == [r.doc_id for r in mixed.collect()]


def test_stages_take_columns_of_their_own_names(spark, odd, tmp_path):
    names = ["mix_file", "mix_row", "mix_slot", "mix_pos", "_row", "_key", "_source", "_slot", "_pos", "_gone", "_doc", "hash", "gone", "shard", "n_tokens", "ids_sha256", "sig", "words"]
    docs = odd.select("doc_id", "text", "source", "lang", *[F.lit(7).alias(n) for n in names])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == ["doc_id", "text", "source", "lang", *names]
    assert docs.filter("mix_file is not null and mix_row is not null").count() == docs.count() > 8


def test_stages_take_an_empty_table(spark, odd):
    empty = odd.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
