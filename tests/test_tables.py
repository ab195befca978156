"""Catalog, selection, runs, reports, sinks and streams on small tables."""

import json
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cavea.functions import sequences, text
from cavea.operators import catalog, reports, runs, selection
from cavea.sources import corpus, sinks
from cavea.streaming import events as streams

VOLUME = "structure_id long, ord int, type string, volume string, x string, y string, z string, circularity string, uniformity string"


@pytest.fixture(scope="module")
def tables(spark):
    s = spark.createDataFrame(
        [(1, "r", "hit-a", "4JPN", 1, 100, 1, 0.5, 0.2, 0.3), (2, "r", "hit-b", "1ABC", 3, 250, 2, 0.1, 0.6, 0.3), (3, "r", "hit-c", "2ABX", 2, 180, 2, 0.8, 0.05, 0.15)],
        "structure_id long, run_id string, source_label string, pdb_id string, num_chains int, num_residues int, num_sequence_unique_chains int, frac_alpha double, frac_beta double, frac_coil double",
    ).withColumns({"annotated_cif_path": F.lit("/x.cif"), "annotation_json_path": F.lit(None).cast("string"), "input_path": F.lit("/in.pdb")})
    v = spark.createDataFrame(
        [(1, 0, " Pore", "200", "12", "5", "3", "0.85", "0.72"), (1, 1, "pocket", "40", "6", "4", "2", "0.6", "0.55"), (2, 0, "pore", "80", "7", "3", "2", "0.9", "0.8"), (3, 0, "pocket", "30", "5", "2", "1", "0.45", "0.35"), (3, 1, "hub", "900", "1", "1", "1", "1", "1"), (3, 2, "pore", "n/a", "1", "1", "1", "1", "1")],
        VOLUME,
    )
    volumes = catalog.rank_in_kind(catalog.indexable(v))
    renders = s.select("structure_id", *[F.lit(None).cast("string").alias(c) for c in ("x_png_path", "y_png_path", "z_png_path")], F.lit("old").alias("render_style_hash"), F.lit("done").alias("render_status"))
    aliases = spark.createDataFrame([(1, "4JPN"), (1, "4JPP"), (2, "1ABC"), (3, "2ABX")], "structure_id long, alias_pdb_id string")
    return {"structures": s, "volumes": volumes, "structure_aggregates": catalog.kind_aggregates(s, volumes), "renders": renders, "structure_pdb_aliases": aliases, "runs": spark.createDataFrame([("r", "2024"), ("q", "2025")], "run_id string, created_at string")}


@pytest.mark.parametrize("kwargs,want", [
    ({"limit": 2}, "ab"), ({"pore_volume_min": 100}, "a"), ({"pore_dmax_max": 3.5}, "b"), ({"chains_min": 2, "chains_max": 2, "residues_min": 150, "residues_max": 200, "seq_unique_chains_min": 2}, "c"),
    ({"pdb_id": "4jpn"}, "a"), ({"pdb_id": "ab"}, "bc"), ({"pdb_id": "4jpp"}, "a"), ({"num_pockets_min": 1, "num_pores_max": 0}, "c"), ({"sort_by": "frac_alpha"}, "cab"), ({"sort_by": "largest_pocket_volume"}, "acb"),
    ({"sort_by": "largest_pore_circularity"}, "bac"), ({"pore_uniformity_min": 0.75}, "b"), ({"hub_volume_min": 1e9}, "abc"), ({"sort_by": "largest_pore_volume_a3", "sort_dir": "asc"}, "bac"), ({"offset": 1}, "bc"), ({"run_id": "q"}, ""),
])
def test_catalog_queries(tables, kwargs, want):
    page, total = catalog.query_catalog(tables, **kwargs)
    assert "".join(r.source_label[-1] for r in page.collect()) == want
    if not {"limit", "offset"} & set(kwargs):
        assert total.first().total == len(want)


@pytest.mark.parametrize("kwargs", [{"sort_by": "num_hubs"}, {"sort_dir": "sideways"}, {"limit": -1}, {"nothing_min": 1}])
def test_bad_catalog_parameters(tables, kwargs):
    with pytest.raises(ValueError):
        catalog.query_catalog(tables, **kwargs)


def test_details_and_renders(tables):
    detail = {r.structure_id: r for r in catalog.viewer_record(catalog.hit_detail(tables), "/api").collect()}
    assert [(v.kind, v.rank_in_kind) for v in detail[1].volumes] == [("pocket", 1), ("pore", 1)] and detail[1].aliases == ["4JPN", "4JPP"] and detail[1].format == "mmcif"
    assert detail[2].urls.structure == "/api/structure/2" and detail[2].urls.annotation is None
    assert [(r.run_id, r.num_structures) for r in catalog.list_runs(tables["runs"], tables["structures"]).collect()] == [("q", 0), ("r", 3)]
    work = tables["renders"].withColumn("outputs_exist", F.col("structure_id") != 2)
    plan = lambda **k: {r.structure_id: r.action for r in catalog.plan_renders(tables["structures"], work, **k).collect()}
    assert plan(style="old") == {1: "skip", 2: "render", 3: "skip"} and set(plan(style="new").values()) == {"render"} and plan(style="old", reuse_only=True)[2] == "skip"
    assert list(catalog.plan_renders(tables["structures"], work, "new", limit=2).filter("action = 'render'").toPandas().structure_id) == [1, 2]
    reset = {r.structure_id: r.render_status for r in catalog.rerender_targets(tables["structures"], tables["structure_pdb_aliases"], tables["renders"], ["4jpp", "HIT-B"]).collect()}
    assert reset == {1: "pending", 2: "pending", 3: "done"}
    with pytest.raises(ValueError):
        catalog.rerender_targets(tables["structures"], tables["structure_pdb_aliases"], tables["renders"], ["none"])
    done = catalog.update_renders(tables["renders"], tables["renders"].filter("structure_id = 1").select("structure_id", F.lit("failed").alias("render_status")))
    assert {r.render_status for r in done.collect()} == {"failed", "done"}
    assert catalog.metric_columns(tables["structures"].join(tables["structure_aggregates"], "structure_id"), "Pores").count() == 3


def test_build_and_write_catalog(spark, tmp_path):
    sections = spark.createDataFrame(
        [("results", 0, "a", None, "1ABC", ["1abc", "2DEF", "2def", "bad"]), ("skipped", 0, "a", "resume_existing_outputs", None, None), ("skipped", 1, "b", "resume_existing_outputs", None, None), ("skipped", 2, "c", "other", None, None), ("results", 1, "lost", None, None, None)],
        "section string, ord int, source string, reason string, pdb_id string, cluster_member_pdb_ids array<string>",
    ).withColumns({c: F.concat(F.lit("/o/"), "source") for c in ("input_path", "structure_output", "annotation_output")})
    notes = spark.createDataFrame([("a", 0, "pore", "5", "1", "2", "3", None, None), ("b", 0, "cavity", "6", "1", "2", "3", None, None)], VOLUME.replace("structure_id long", "source string"))
    notes = notes.withColumns({f"frac_{f}": F.lit(0.5) for f in ("alpha", "beta", "coil")})
    built = catalog.build_catalog(sections, notes, None, "run1", "2024")
    assert {r.source_label for r in built["structures"].collect()} == {"a", "b"}
    assert {(r.alias_pdb_id, r.alias_source) for r in built["structure_pdb_aliases"].collect()} == {("1ABC", "canonical"), ("2DEF", "cluster_member")}
    with pytest.raises(Exception, match="no annotation"):
        catalog.build_catalog(sections, notes, None, "run1", "2024", strict=True)["structures"].collect()
    folder = str(tmp_path / "catalog")
    sinks.write_catalog(built, folder, "run1")
    with pytest.raises(ValueError):
        sinks.write_catalog(built, folder, "run1")
    sinks.write_catalog(built, folder, "run1", replace=True)
    assert corpus.scan_catalog(spark, folder)["volumes"].count() == 2


LINES = ["4jpn_1 4jpp_1 4JPP_2 BADTOKEN af_test_1", "1abc_1 1abd_2 1ABC_3 1ABE_1", "not_a_pdb"]


def test_clusters(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(LINES))
    lines = corpus.scan_cluster_lines(spark, str(tmp_path / "c.txt"))
    got = {}
    for r in selection.parse_members(lines).orderBy("rep_ord", "member_ord").collect():
        got.setdefault(r.rep_id, []).append(r.member_id)
    assert got == {"4JPN": ["4JPN", "4JPP"], "1ABC": ["1ABC", "1ABD", "1ABE"]}
    reps = spark.createDataFrame(list(enumerate(["1abc_1 9xyz_1", "2def_2 1abc_1", "AF_TEST_1 4jkl_1", "1ABC_3 4jkl_2"])), "line int, value string")
    order = lambda df: [r.rep_id for r in df.orderBy("rep_ord").collect()]
    assert order(selection.parse_reps(reps)) == ["1ABC", "2DEF"] and order(selection.parse_reps(reps, True)) == ["1ABC", "2DEF", "AF"]
    four = spark.createDataFrame([(i, f"{x}_1") for i, x in enumerate(["1ABC", "2DEF", "3GHI", "4JKL"])], "line int, value string")
    assert order(selection.shard_filter(selection.parse_reps(four), 2, 1)) == ["2DEF", "4JKL"]
    with pytest.raises(ValueError):
        selection.shard_filter(four, 2, 2)


def test_entry_filters(spark):
    meta = spark.createDataFrame([(1, [("x-ray diffraction",)], (["2.1", "x"], "10")), (2, [("ELECTRON MICROSCOPY",)], (None, None)), (3, None, (["3"], "99"))], f"id int, {corpus.META}")
    why = lambda *a: [r.reason for r in selection.entry_filter(meta, *a).orderBy("id").collect()]
    assert why(["xray"]) == [None, "experimental_method", "experimental_method"] and why(["cryo_em"]) == ["experimental_method", None, "experimental_method"]
    assert why(None, 2.0) == ["resolution", "missing_resolution", "experimental_method"] and why(None, 3.0, 5)[0] == "residue_count"
    store = spark.createDataFrame([("4JPN", "entry", [("X-RAY DIFFRACTION",)], (["1.5"], "5")), ("1ABC", "negative", None, None)], f"pdb_id string, kind string, {corpus.META}")
    lines = spark.createDataFrame(list(enumerate(LINES)), "line int, value string")
    chosen, lost, counts = selection.select_representatives(lines, store, None, 3.0)
    assert [(r.rep_id, r.cluster_member_pdb_ids) for r in chosen.collect()] == [("4JPN", ["4JPN", "4JPP"])] and [(r.rep_id, r.reason) for r in lost.collect()] == [("1ABC", "metadata_negative")]
    assert counts.first().examined == 2 and counts.first().metadata_hit == 1
    kept, removed = selection.clear_negative(store)
    assert kept.count() == 1 and removed.first().removed == 1


def test_sequences(spark):
    pairs = [("abcdefghij", "abcdefgh", 0.8), ("abcde", "cde", 0.6), ("abc", "xyz", 0.0), ("", "", 1.0), ("ab", "", 0.0), ("abc", "abc", 1.0)]
    df = spark.createDataFrame([(list(a), list(b), w) for a, b, w in pairs], "a array<string>, b array<string>, w double")
    assert all(r.got == pytest.approx(r.w) for r in df.withColumn("got", sequences.sequence_overlap(F.col("a"), F.col("b"))).collect())
    base = list("ABCDEFGHIJ" * 10)
    near, far = base[:97] + ["Z"] * 3, base[:94] + ["Z"] * 6
    for chains, n in (([base] * 3, 1), ([base, near], 1), ([base, far], 2), ([], 0)):
        one = spark.createDataFrame([(chains,)], "c array<array<string>>")
        assert one.select(sequences.unique_chain_count(F.col("c"))).first()[0] == n


@pytest.mark.parametrize("threshold", [0.95, 0.7, 1.0])
def test_unique_chains_by_blocks(spark, threshold):
    """Mutated, shifted, cut and repeated chains: as the comparison of all pairs."""
    deal = random.Random(7)
    rows = []
    for structure in range(12):
        base = [deal.choice("ABCDEF" if structure % 3 else "A") for _ in range(deal.choice([1, 5, 19, 20, 40, 97]))]
        for k in range(9):
            chain = [deal.choice("ABCXYZ") if deal.random() < (0, 0.02, 0.05, 0.3)[k % 4] else c for c in base]
            cut = deal.choice([0, 0, 1, 2, 5])
            chain = (chain[cut:] if k % 2 else chain[: len(chain) - cut]) or chain
            rows.append((structure, f"c{k}", chain + list("QR")[: deal.choice([0, 0, 1, 2])]))
    chains = spark.createDataFrame(rows, "structure_id int, chain_id string, sequence array<string>")
    got = dict(map(tuple, sequences.unique_chains(chains, threshold).collect()))
    listed = chains.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("chain_id", "sequence"))).alias("c"))
    want = dict(map(tuple, listed.select("structure_id", sequences.unique_chain_count(F.transform("c", lambda x: x["sequence"]), threshold)).collect()))
    assert got == want and len(set(want.values())) > 2
    with pytest.raises(ValueError):
        sequences.unique_chains(chains, 0.0)


def test_resume_replay_and_progress(spark):
    events = spark.createDataFrame([("a", "planned", 1), ("a", "errors", 2), ("a", "results", 3), ("b", "errors", 4), ("b", "planned", 5), ("c", "planned", 6)], "source string, section string, seq int").withColumn("input_path", F.col("source"))
    last, counts, failed = runs.summarize_run(events)
    assert {r.source: r.section for r in last.collect()} == {"a": "results", "b": "errors", "c": "planned"} and not counts.first().ok and [r.source for r in failed.collect()] == ["b"]
    with pytest.raises(ValueError):
        runs.replay(events, "some")
    good = {"source": "s", "input_path": "i", "output_structure_cif": "/o/s.annotated.cif", "num_volumes": 1, "volumes": [{}]}
    cases = {
        None: None, "annotation JSON is invalid": "{x", "annotation JSON root must be an object": "[1]", "annotation JSON missing required keys: volumes": {k: v for k, v in good.items() if k != "volumes"},
        "annotation source mismatch: expected s, found t": good | {"source": "t"}, "annotation output_structure_cif must be a non-empty string": good | {"output_structure_cif": 5},
        "annotation output_structure_cif does not match expected path: /q": good | {"output_structure_cif": "/q"}, "annotation volumes must be a list": good | {"volumes": {}},
        "annotation num_volumes must be an integer": good | {"num_volumes": "1"}, "annotation num_volumes does not match volumes length: 2 != 1": good | {"num_volumes": 2},
    }
    rows = [("s", "/o/s.annotated.cif", "/o/s.annotation.json", 5, 5, True, True, p if isinstance(p, str) else json.dumps(p or good), why) for why, p in cases.items()]
    rows += [("s", "/o/s.annotated.cif", "/o/s.annotation.json", 0, 5, True, True, "", "structure output is empty: /o/s.annotated.cif"), ("s", "/o/s.annotated.cif", "/o/s.annotation.json", None, 5, None, True, "", "s.annotation.json"), ("s", "/o/s.annotated.cif", "/o/s.annotation.json", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, structure_output string, annotation_output string, structure_bytes int, annotation_bytes int, structure_is_file boolean, annotation_is_file boolean, payload string, want string")
    status, reason = runs.resume_status()
    got = df.withColumns({"status": status, "reason": reason}).collect()
    assert all(r.reason == r.want for r in got) and [r.status for r in got] == ["valid"] + ["invalid"] * 10 + ["partial", "missing"]
    clock = spark.createDataFrame([(0, "done"), (10, "done"), (20, "bad")], "t long, event string").withColumn("ts", F.timestamp_seconds("t"))
    r = runs.progress(clock, 6, ["done"], ["bad"]).first()
    assert (r.completed, r.failed, r.percent, r.eta) == (3, 1, 50.0, "00:20")


def test_text_functions(spark):
    row = spark.range(1).select(
        text.sanitize_label(F.lit(" A b/c. ")).alias("label"), text.sanitize_label(F.lit("//")).alias("none"), text.normalize_id(F.lit(" 4jpn ")).alias("id"), text.normalize_id(F.lit("4jp")).alias("bad"),
        text.status_code(F.lit("HTTP Error 404: no")).alias("code"), text.eta_text(F.lit(3725.0)).alias("eta"), text.eta_text(F.lit(None).cast("double")).alias("unknown"), text.structure_format(F.lit("/a/b.CIF")).alias("fmt"),
        text.member_ids(F.array(F.lit("4jpn"), F.lit("4JPN"), F.lit("x"))).alias("ids"), text.control_byte(F.unhex(F.lit("41000A"))).alias("byte"), text.control_byte(F.unhex(F.lit("410A0D09"))).alias("fine"),
        text.style_hash(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("h1"), text.style_hash(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))).alias("h2"), text.method_alias(F.lit("Cryo_EM")).alias("method"),
    ).first()
    assert (row.label, row.none, row.id, row.bad, row.code, row.eta, row.unknown, row.fmt, row.ids) == ("a_b_c", "structure", "4JPN", None, 404, "1:02:05", "unknown", "mmcif", ["4JPN"])
    assert row.byte == "contains control byte 0x00" and row.fine is None and row.h1 == row.h2 and len(row.h1) == 16 and row.method == "em"


NOTES = "structure_id string, id int, type string, volume double, x double, y double, z double, circularity double, uniformity double"


def test_sinks_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([("s", 0, "pore", 9.0, 3.0, 2.0, 1.0, 0.5, None), ("s", 0, "pocket", 4.0, 3.0, 2.0, 1.0, None, None)], NOTES)
    sinks.write_annotation_json(notes, str(tmp_path / "json"))
    sinks.write_annotation_columnar(notes, str(tmp_path / "col"))
    payload = json.loads(sinks.annotation_payload(notes).first().payload)
    assert payload["num_volumes"] == 2 and payload["largest_type"] == "pore" and [v["type"] for v in payload["volumes"]] == ["pore", "pocket"]
    back = corpus.scan_annotations(spark, str(tmp_path / "json/structure_id=s"))
    assert [(r.ord, r.type, float(r.volume)) for r in back.orderBy("ord").collect()] == [(0, "pore", 9.0), (1, "pocket", 4.0)]
    rows = corpus.scan_annotations_columnar(spark, str(tmp_path / "col/structure_id=s")).orderBy(*corpus.row_key_order()).collect()
    assert [(r.type, r.volume, r.circularity) for r in rows] == [("pore", 9.0, 0.5), ("pocket", 4.0, None)]
    atoms = spark.createDataFrame([("s", 0, i, "ATOM", "CA", "C", "ALA", 7, "", "A", 1.0, -2.5, 3.25, 0.0) for i in range(2)], "structure_id string, part int, atom_seq long, group_pdb string, atom_name string, element string, res_name string, res_id int, ins_code string, chain_id string, x double, y double, z double, b_factor double")
    lines = [r.value for r in sinks.pdb_lines(atoms).orderBy("part", "idx").collect()]
    assert lines[0] == "ATOM      0  CA  ALA A   7       1.000  -2.500   3.250  1.00  0.00           C" and lines[-1] == "END"
    sinks.write_annotated_pdb(atoms, str(tmp_path / "pdb"))
    sinks.write_annotated_cif(atoms, str(tmp_path / "cif"))
    text_ = spark.read.text(str(tmp_path / "cif"), wholetext=True).first().value
    assert text_.startswith("data_structure\nloop_\n_entity.id") and "1 polymer" in text_


def test_run_files(spark, tmp_path):
    entries = spark.createDataFrame([("results", 0, "a", "/a.cif", None), ("errors", 0, "b", "/b.cif", "boom"), ("errors", 1, "b", "/b.cif", "boom")], "section string, ord int, source string, input_path string, error string")
    sinks.write_run_summary(entries, str(tmp_path / "run"), {"size": "2"})
    back = corpus.scan_run_summary(spark, str(tmp_path / "run"))
    assert {(r.section, r.source) for r in back.collect()} == {("results", "a"), ("errors", "b")}
    listed = entries.limit(1).withColumns({"pdb_id": F.lit("1ABC"), "cluster_member_pdb_ids": F.array(F.lit("1ABC"))})
    sinks.write_manifest(listed, str(tmp_path / "manifest"))
    assert corpus.scan_manifest(spark, str(tmp_path / "manifest")).first().input_path == "/a.cif"
    kept, gone = runs.drop_sources(entries, entries.filter("source = 'b'").select("source"))
    assert kept.count() == 1 and gone.first().removed == 2
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/1abc.json").write_bytes(json.dumps({"pdb_id": "1ABC", "kind": "entry", "entry_metadata": {"exptl": [{"method": "X-RAY DIFFRACTION"}], "rcsb_entry_info": {"resolution_combined": [2.1], "deposited_polymer_monomer_count": 5}}}).encode() + b" \n")
    (tmp_path / "meta/2abc.json").write_text("{bad")
    store = corpus.scan_metadata_store(spark, str(tmp_path / "meta")).collect()
    assert [(r.pdb_id, r.kind, r.rcsb_entry_info.resolution_combined) for r in store] == [("1ABC", "entry", ["2.1"])]
    (tmp_path / "x.cif").write_bytes(b"a\x01")
    assert [r.reason for r in reports.scan_corruption(corpus.scan_bytes(spark, str(tmp_path))).collect()] == ["contains control byte 0x01"]


def test_streams_equal_batches(spark, tmp_path):
    schema = "source string, section string, seq long"
    for k, rows in enumerate([[("a", "errors", 1), ("b", "planned", 2)], [("a", "results", 3), ("b", "skipped", 4)]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("source", "section", "seq"), r))) for r in rows))
    feed = streams.event_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    streams.stream_run_state(feed, str(tmp_path / "state"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    want = runs.latest_state(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted(map(tuple, streams.run_state(spark, str(tmp_path / "state")).select("source", "section", "seq").collect())) == sorted(map(tuple, want.select("source", "section", "seq").collect()))
    files = streams.event_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    streams.stream_index(files, str(tmp_path / "index"), str(tmp_path / "log2"), lambda b: b.groupBy("source").agg(F.max("seq").alias("seq")), ["source"]).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def write_lines(folder, batches, fields):
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(fields, r))) for r in rows))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k,) * 2)  # a stream takes files by age
    return str(folder)


def test_run_state_in_deltas(spark, tmp_path):
    schema, state = "source string, section string, seq long", str(tmp_path / "state")
    batches = [[("a", "errors", 1), ("b", "planned", 9), ("c", "skipped", 1)], [("a", "results", 3), ("b", "skipped", 4)], [("c", "planned", 99)]]

    def run():
        feed = streams.event_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
        streams.stream_run_state(feed, state, str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, streams.run_state(spark, state).collect()))

    write_lines(tmp_path / "in", batches[:2], ("source", "section", "seq"))
    assert run() == [("a", "results", 3), ("b", "skipped", 4), ("c", "skipped", 1)]
    # the second batch has written its own sources alone
    assert {r.source for r in spark.read.parquet(f"{state}/delta/batch=1").collect()} == {"a", "b"}
    streams.folded(spark, state, streams.run_state)
    assert not list((tmp_path / "state/delta").glob("batch=*")) and len(list((tmp_path / "state/base").glob("upto=*"))) == 1
    (tmp_path / "in/2.json").write_text(json.dumps({"source": "c", "section": "planned", "seq": 99}))
    assert run() == [("a", "results", 3), ("b", "skipped", 4), ("c", "skipped", 1)]
    (tmp_path / "in/3.json").write_text(json.dumps({"source": "d", "section": "planned", "seq": 5}))
    assert run()[-1] == ("d", "planned", 5)
    shutil.rmtree(tmp_path / "state/delta/batch=2")
    with pytest.raises(FileNotFoundError):
        streams.run_state(spark, state)
    with pytest.raises(FileNotFoundError):
        streams.run_state(spark, str(tmp_path / "none"))


def test_rates_of_intervals_and_late_rows(spark, tmp_path):
    day = "2024-01-0{} {:02d}:00:00".format
    batches = [[(day(1, h), "done" if h % 3 else "failed") for h in range(12)] + [(None, "done")], [(day(4, h), "done") for h in range(3)], [(day(4, h), "done") for h in range(3, 6)], [(day(1, 1), "done"), (day(4, 7), "failed"), (day(4, 8), "other")]]
    folder = write_lines(tmp_path / "in", batches, ("ts", "event"))
    feed = streams.event_stream(spark, folder, "ts timestamp, event string", files_per_trigger=1)
    listener = streams.ProgressListener(total=40)
    spark.streams.addListener(listener)
    try:
        streams.stream_rates(feed, str(tmp_path / "rates"), str(tmp_path / "log"), ["done"], ["failed"], "6 hours", "1 day").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.rows == 21:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {str(r.start)[8:13]: (r.events, r.completed, r.failed, r.rate, r.failed_share) for r in streams.rates(spark, str(tmp_path / "rates")).collect()}
    assert got == {"01 00": (6, 6, 2, 6 / 21600, 2 / 6), "01 06": (6, 6, 2, 6 / 21600, 2 / 6), "04 00": (6, 6, 0, 6 / 21600, 0.0), "04 06": (2, 1, 1, 1 / 21600, 1.0)}
    # the row of the first day comes three days late
    assert (listener.rows, listener.completed, listener.failed, listener.late(streams.rates(spark, str(tmp_path / "rates")))) == (21, 21, 5, 1)
    row = listener.table(spark).first()
    assert (row.completed, row.percent) == (21, 52.5) and row.eta == spark.range(1).select(text.eta_text(F.lit(listener.seconds_left))).first()[0]
    table = spark.read.schema("ts timestamp, event string").json(folder)
    assert streams.interval_rates(table, ["done"], ["failed"], "6 hours").agg(F.sum("events")).first()[0] == 21
    assert streams.ProgressListener().seconds_left is None and streams.ProgressListener().rate == 0.0


def test_index_in_buckets(spark, tmp_path):
    batches = [[("a", 1), (None, 2), ("b", 3)], [("a", 4), (None, 5), ("c", 6)], [("c", 7), ("d", 8), ("d", 9)]]
    folder, index = write_lines(tmp_path / "in", batches, ("source", "seq")), str(tmp_path / "index")
    feed = streams.event_stream(spark, folder, "source string, seq long", files_per_trigger=1)
    streams.stream_index(feed, index, str(tmp_path / "log"), lambda b: b, ["source"], buckets=4).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(index)
    assert {(r.source, r.seq) for r in rows.collect()} == {("a", 1), (None, 2), ("b", 3), ("c", 6), ("d", 8), ("d", 9)}
    assert rows.filter(F.col("bucket") != F.pmod(F.hash("source"), F.lit(4))).count() == 0


def test_run_files_in_parts(spark, tmp_path):
    n = 3000
    entries = spark.range(n, numPartitions=7).select(
        F.element_at(F.array(*map(F.lit, ["results", "planned", "skipped"])), (F.col("id") % 3 + 1).cast("int")).alias("section"), (-F.col("id")).alias("ord"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit('s"\n],'), F.col("id").cast("string"))).alias("source"), F.lit("/x.cif").alias("input_path"),
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_run_summary(entries, str(tmp_path / "run"), {"a": "1"})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted((tmp_path / "run").glob("part-*"))
    assert len(parts) > 1
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["config"] == {"a": "1"} and (whole["num_processed"], whole["num_failed"], whole["errors"]) == (n // 3, 0, [])
    want = {(s, k, e.get("source")) for s in ("results", "planned", "skipped") for k, e in enumerate(whole[s])}
    assert len(want) == n and whole["results"][0]["source"] == 's"\n],2997'
    assert {(r.section, r.ord, r.source) for r in corpus.scan_run_summary(spark, str(tmp_path / "run")).collect()} == want
    # one document of any other layout gives the same rows
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=1))
    assert {(r.section, r.ord, r.source) for r in corpus.scan_run_summary(spark, str(tmp_path / "one.json")).collect()} == want
    none = entries.limit(0)
    sinks.write_run_summary(none, str(tmp_path / "empty"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "empty").glob("part-*"))))["planned"] == []
    assert corpus.scan_checkpoint(spark, str(tmp_path / "empty")).count() == 0
    listed = entries.filter("source is not null").withColumns({"pdb_id": F.lit(None).cast("string"), "cluster_member_pdb_ids": F.array(F.lit("1ABC"))})
    gone = spark.createDataFrame([("r2", "x"), ("r1", None)], "rep_id string, reason string")
    sinks.write_manifest(listed, str(tmp_path / "manifest"), gone)
    back = json.loads("".join(p.read_text() for p in sorted((tmp_path / "manifest").glob("part-*"))))
    assert back["summary"]["num_structures"] == len(back["structures"]) == 2400 and [r["rep_id"] for r in back["rejections"]] == ["r1", "r2"]
    assert corpus.scan_manifest(spark, str(tmp_path / "manifest")).count() == 2400


def test_cluster_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x_1 y_2\r\n\r\n  \nz_1")
    (tmp_path / "b.txt").write_bytes(b"\nlast_1\n")
    assert sorted(map(tuple, corpus.scan_cluster_lines(spark, str(tmp_path)).collect())) == [(0, "x_1 y_2"), (1, "last_1"), (3, "z_1")]


def test_bench_and_comparison(spark):
    b = spark.createDataFrame([("c", 1, 2.0, 2048, "pore", {"s": 1.0}), ("c", 2, 4.0, 1024, "hub", {"s": 1.0, "t": 2.0})], "case_name string, seq int, elapsed_seconds double, max_rss_kb long, largest_type string, stages map<string,double>")
    s = reports.bench_summary(b).first()
    assert (s.mean_seconds, s.min_seconds, s.max_rss_mb, s.largest_type) == (3.0, 2.0, 2.0, "hub")
    assert {r.stage: (r["mean"], r.percent) for r in reports.stage_means(b).collect()} == {"s": (1.0, 33.333), "t": (1.0, 33.333), "untracked": (1.0, 33.333)}
    one = spark.createDataFrame([("s", 0, "pore", 9.0, 3.0, 2.0, 1.0, None, None)], NOTES)
    assert reports.compare_annotations(one, one).filter("not matches").count() == 0
    assert reports.compare_annotations(one, one.withColumn("volume", F.lit(8.0))).filter("not matches").count() == 1


def test_registered_queries_and_oracles():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


def test_status_records(spark, tmp_path):
    for name, body in {"a.status.json": '{"kind": "terminal_skip", "source": "a", "actual_residues": 7}', "b.status.json": "", "c.status.json": "{oops", "d.json": '{"source": "d"}'}.items():
        (tmp_path / name).write_text(body)
    rows = corpus.scan_status_records(spark, str(tmp_path)).collect()
    assert [(r.source, r.record.kind, r.record.actual_residues) for r in rows] == [("a", "terminal_skip", 7)]


def test_cif_values_come_back(spark, tmp_path):
    from cavea.sources.structures import scan_cif_atoms

    odd = ["CA", "O5'", "a b", "it's x", '"q" \'r s', "_x", "loop_", "data_1", "#1", ";s", "[k]", "x;y", "two\nlines", "$d", "5'' z"]
    rows = [("s", 0, i, "ATOM", n, "C", "ALA", i, "B" if i % 2 else "", "AbC9", 1.0, -2.5, 3.25, 0.0, 1 + i % 2) for i, n in enumerate(odd)]
    atoms = spark.createDataFrame(rows, "structure_id string, part int, atom_seq long, group_pdb string, atom_name string, element string, res_name string, res_id int, ins_code string, chain_id string, x double, y double, z double, b_factor double, model int")
    sinks.write_annotated_cif(atoms, str(tmp_path / "cif"))
    back = scan_cif_atoms(spark, str(tmp_path / "cif/*")).orderBy("atom_seq").collect()
    assert [(r.atom_name, r.res_id, r.ins_code, r.chain_id, r.model, r.x) for r in back] == [(n, i, "B" if i % 2 else "", "AbC9", 1 + i % 2, 1.0) for i, n in enumerate(odd)]


def test_a_structure_is_one_cif_file(spark, tmp_path):
    from cavea.sources.structures import scan_cif_atoms

    k = F.col("atom_seq")
    atoms = spark.range(6000).withColumnRenamed("id", "atom_seq").select("atom_seq", (k % 3).alias("structure_id"), F.lit("ATOM").alias("group_pdb"), F.lit("CA").alias("atom_name"), F.lit("C").alias("element"), F.lit("ALA").alias("res_name"), (k % 90).alias("res_id"), F.lit("A").alias("chain_id"), *[(k / 8).alias(c) for c in "xyz"], F.lit(1.0).alias("b_factor"), F.lit(0).alias("part"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        sinks.write_annotated_cif(atoms, str(tmp_path / "cif"))
    finally:
        for key in small:
            spark.conf.unset(key)
    assert [len(list(folder.glob("part-*"))) for folder in (tmp_path / "cif").glob("structure_id=*")] == [1, 1, 1]
    assert scan_cif_atoms(spark, str(tmp_path / "cif/*")).count() == 6000


def held_against_sql(spark, name, folder, **tables):
    """Rows of a query and of its SQL over ``tables`` (DuckDB SELECTs), sorted."""
    import duckdb

    with duckdb.connect() as db:
        for table, select in tables.items():
            db.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
            db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
        want = db.execute(entry.oracle_sql()[name]).fetchall()
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect())), sorted(want)


def test_equal_volumes_of_columns_go_by_id(spark, tmp_path):
    customer = "SELECT k::BIGINT AS c_custkey, 7 AS c_nationkey, ['b', 'a', 'c'][k % 3 + 1] AS c_mktsegment, (k // 4)::DOUBLE AS c_acctbal FROM range(40) t(k)"
    found, want = held_against_sql(spark, "s07_annotation_columns", tmp_path, customer=customer)
    assert found == want and len(found) == 40


def test_first_of_equal_largest_volumes(spark, tmp_path):
    lineitem = "SELECT (k % 20)::BIGINT AS l_orderkey, ['N', 'R', 'A'][(k * 7 % 20 + k // 20) % 3 + 1] AS l_returnflag, 5.0::DOUBLE AS l_extendedprice, (100 - k)::BIGINT AS l_partkey, 1.0::DOUBLE AS l_quantity FROM range(60) t(k)"
    found, want = held_against_sql(spark, "a15_largest_volume", tmp_path, lineitem=lineitem)
    assert found == want and {r[2] for r in found} == {"pore", "pocket"}


def test_rerendered_ids_name_one_structure(spark, tmp_path):
    orders = "SELECT k::BIGINT AS o_orderkey, 5::BIGINT AS o_custkey, ['P', 'F', 'O'][k % 3 + 1] AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM (SELECT unnest([1, 2, 6, 7, 65537, 65543, 131079, 4294967303]) AS k)"
    lineitem = "SELECT 1::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey"
    found, want = held_against_sql(spark, "i05_rerender_targets", tmp_path, orders=orders, lineitem=lineitem)
    assert found == want and [r[0] for r in found if r[2] is None] == [1, 6, 7]


def test_columns_of_many_rows(spark, tmp_path):
    n = 20000
    whole = {c: {str(i): i for i in range(n)} for c in ("id", "type", "volume", "x", "y", "z")}
    odd = whole | {"x": {str(i): i for i in reversed(range(n)) if i % 2} | {"more": 1}, "y": None, "cross_section_uniformity": {"7": 0.5}}
    for name, body in (("a", whole), ("b", odd), ("c", {k: v for k, v in whole.items() if k != "z"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    began = time.time()
    rows = corpus.scan_annotations_columnar(spark, str(tmp_path)).collect()
    assert time.time() - began < 60  # minutes where each row looks through the maps
    assert sorted((r.source, int(r.key), r.id, r.type, r.volume, r.x, r.y, r.z, r.circularity, r.uniformity) for r in rows) == [
        (s, i, i, str(i), i, i if s == "a" or i % 2 else None, i if s == "a" else None, i, None, 0.5 if s == "b" and i == 7 else None) for s in "ab" for i in range(n)
    ]


def test_run_files_are_read_without_an_exchange(spark, tmp_path, capsys):
    entries = spark.range(600, numPartitions=5).select(F.lit("results").alias("section"), F.floor(F.col("id") / 200).alias("ord"), F.when(F.col("id") > 3, F.floor(F.col("id") / 3)).cast("string").alias("source"))
    for name, more in (("plain", {}), ("packed", {"compression": "gzip"})):
        sinks.write_run_summary(entries, str(tmp_path / name), **more)
        rows = corpus.scan_checkpoint(spark, str(tmp_path / name))
        capsys.readouterr()
        rows.explain()
        plan = capsys.readouterr().out
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Window" not in plan
        back = sorted((r.ord, r.source) for r in rows.collect())
        # the same entry several times at the start, and entries equal in ord by their JSON
        want = sorted((i // 200, json.dumps({"source": str(i // 3)} if i > 3 else {}, separators=(",", ":"))) for i in range(600))
        assert back == [(k, json.loads(e).get("source")) for k, (_, e) in enumerate(want)]
    assert all(p.name.endswith(".gz") for p in (tmp_path / "packed").glob("part-*"))
