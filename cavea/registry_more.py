"""More queries over the driver's tables: files written and read back, records, catalog
pages, shapes and patches of surfaces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import views
from .functions import geometry, sequences, text
from .operators import catalog, metrics, prep, runs, selection, topology, voxels
from .operators.steps import settled, shared_dir
from .plans import annotate
from .registry import AGG, CFG, COMPS, EV, EXPOSED, SID, STEPS, STR, VOL, query
from .sources import corpus, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# files


def _annotations(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias(SID), F.col("l_linenumber").cast("int").alias("id"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("volume"), F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_discount").alias("circularity"), F.col("l_tax").alias("uniformity"),
    )


@query("SELECT l_orderkey::VARCHAR AS source, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) - 1)::INT AS ord, l_extendedprice AS volume FROM lineitem")
def s06_annotation_files(spark, d):
    at = _folder(spark, "annotations")
    sinks.annotation_payload(_annotations(spark, d)).select(F.col("payload").alias("value")).write.text(at)
    return corpus.scan_annotations(spark, at, lines=True).select("source", "ord", F.col("volume").cast("double").alias("volume"))


@query("""SELECT (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1)::VARCHAR AS key, c_custkey::INT AS id, c_mktsegment AS type, c_acctbal AS volume FROM customer""")
def s07_annotation_columns(spark, d):
    at = _folder(spark, "columns")
    c = views.table(spark, d, "customer")
    zero = F.lit(1.0)
    rows = c.select(F.col("c_nationkey").alias(SID), F.col("c_custkey").cast("int").alias("id"), F.lit("").alias("t"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("volume"), *[zero.alias(k) for k in ("x", "y", "z", "circularity", "uniformity")])
    sinks.write_annotation_columnar(rows.drop("t"), at, [F.desc("volume"), "id"])
    return corpus.scan_annotations_columnar(spark, f"{at}/*").select("key", "id", "type", "volume")


def _entries(spark, d):
    k = F.col("s_suppkey")
    section = F.element_at(F.array(*map(F.lit, corpus.SECTIONS)), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("s"), k.cast("string"))
    return views.table(spark, d, "supplier").select(section.alias("section"), k.alias("ord"), name.alias("source"), F.concat(F.lit("/in/"), name, F.lit(".cif")).alias("input_path"), F.col("s_acctbal").alias("largest_volume"))


@query("""SELECT ['results','errors','skipped','planned'][s_suppkey % 4 + 1] AS section, (row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1)::INT AS ord, 's' || s_suppkey AS source, s_acctbal AS largest_volume FROM supplier""")
def s08_run_summary_file(spark, d):
    at = _folder(spark, "summary")
    sinks.write_run_summary(_entries(spark, d), at, {"voxel": "2"})
    return corpus.scan_run_summary(spark, at).select("section", "ord", "source", "largest_volume")


@query("""WITH e AS (SELECT ['results','errors','skipped','planned'][(l_orderkey + l_linenumber) % 4 + 1] AS section, 'o' || l_orderkey || '_' || l_linenumber AS source, l_orderkey AS actual_residues, l_extendedprice AS largest_volume FROM lineitem)
  SELECT section, (row_number() OVER (PARTITION BY section ORDER BY actual_residues, largest_volume, source) - 1)::INT AS ord, source, actual_residues, largest_volume FROM e""")
def s10_checkpoint_file(spark, d):
    """A checkpoint of all line items, in several files, read back in its order."""
    at = _folder(spark, "checkpoint")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    section = F.element_at(F.array(*map(F.lit, corpus.SECTIONS)), ((k + n) % 4 + 1).cast("int"))
    source = F.concat_ws("_", F.concat(F.lit("o"), k.cast("string")), n.cast("string"))
    rows = views.table(spark, d, "lineitem").select(section.alias("section"), F.struct(k.alias("k"), F.col("l_extendedprice").alias("v"), source.alias("s")).alias("ord"), source.alias("source"), k.alias("actual_residues"), F.col("l_extendedprice").alias("largest_volume"))
    sinks.write_run_summary(rows, at, {"resume": "true"}, "gzip")
    return corpus.scan_checkpoint(spark, at).select("section", "ord", "source", "actual_residues", "largest_volume")


@query("SELECT (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::INT AS line, l_orderkey || '_' || l_linenumber || ' ' || l_partkey || '_1' AS value FROM lineitem")
def s04_cluster_lines(spark, d):
    """A file of lines for each return flag, read back with the number of each line."""
    at = _folder(spark, "lines")
    number = lambda c: F.col(c).cast("string")
    line = F.concat(number("l_orderkey"), F.lit("_"), number("l_linenumber"), F.lit(" "), number("l_partkey"), F.lit("_1"))
    rows = views.table(spark, d, "lineitem").withColumn("value", line).repartition("l_returnflag").sortWithinPartitions("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    rows.select("l_returnflag", "value").write.partitionBy("l_returnflag").text(at)
    return corpus.scan_cluster_lines(spark, f"{at}/*")


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS ord, 's' || s_suppkey AS source, '/in/s' || s_suppkey || '.cif' AS input_path FROM supplier")
def s09_manifest_file(spark, d):
    at = _folder(spark, "manifest")
    rows = _entries(spark, d).select("ord", "source", F.lit(None).cast("string").alias("pdb_id"), "input_path", F.array(F.col("source")).alias("cluster_member_pdb_ids"))
    sinks.write_manifest(rows, at)
    return corpus.scan_manifest(spark, at).select("ord", "source", "input_path")


@query("SELECT 's' || s_suppkey AS source, '/in/s' || s_suppkey || '.cif' AS input_path FROM supplier WHERE s_suppkey % 4 = 1")
def s21_failures_manifest(spark, d):
    at = _folder(spark, "failures")
    entries = _entries(spark, d).withColumn("pdb_id", F.lit(None).cast("string")).withColumn("cluster_member_pdb_ids", F.array().cast("array<string>"))
    sinks.write_failures_manifest(entries, at)
    return corpus.scan_manifest(spark, at).select("source", "input_path")


@query("SELECT sum(strlen(coalesce(html, '')) + 1)::BIGINT AS bytes FROM pages")
def s12_scan_bytes(spark, d):
    at = _folder(spark, "bytes")
    views.table(spark, d, "pages").select(F.coalesce("html", F.lit("")).alias("value")).write.text(at)
    return corpus.scan_bytes(spark, at, "*.txt").agg(F.sum("length").alias("bytes"))


def _built(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("o"), k.cast("string"))
    none = F.lit(None).cast("string")
    sections = views.table(spark, d, "orders").select(
        F.lit("results").alias("section"), k.alias("ord"), name.alias("source"), none.alias("reason"), views.code4(k).alias("pdb_id"), F.concat(F.lit("/in/"), name, F.lit(".cif")).alias("input_path"),
        F.concat(F.lit("/out/"), name).alias("structure_output"), none.alias("annotation_output"), F.array(views.code4(k + 1)).alias("cluster_member_pdb_ids"),
    )
    volumes = views.v_volumes(spark, d).withColumn("source", F.concat(F.lit("o"), F.col(SID).cast("string"))).withColumns({f"frac_{f}": F.lit(0.25) for f in ("alpha", "beta", "coil")})
    return sections, catalog.build_catalog(sections, volumes.drop(SID), None, "r1", "2024")


@query(VOL + ", n AS (SELECT structure_id, count(*) FILTER (WHERE kind='pore') AS num_pores, count(*) FILTER (WHERE kind='cavity') AS num_cavities, max(volume_a3) FILTER (WHERE kind='pocket') AS largest_pocket_volume_a3 FROM r GROUP BY 1) SELECT 'o' || structure_id AS source_label, printf('%04X', structure_id % 65536) AS pdb_id, num_pores, num_cavities, largest_pocket_volume_a3, 'pending' AS render_status FROM n")
def s13_catalog_tables(spark, d):
    at = _folder(spark, "catalog")
    sinks.write_catalog(_built(spark, d)[1], at, "r1")
    t = corpus.scan_catalog(spark, at)
    rows = t["structures"].drop("run_id").join(t["structure_aggregates"].drop("run_id"), SID).join(t["renders"].drop("run_id"), SID)
    return rows.select("source_label", "pdb_id", "num_pores", "num_cavities", "largest_pocket_volume_a3", "render_status")


@query("SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS indexed_structures, (SELECT count(*) FROM lineitem) AS indexed_volumes, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS skipped")
def a32_index_counters(spark, d):
    sections, tables = _built(spark, d)
    return catalog.index_counters(tables, catalog.summary_entries(sections))


@query("SELECT event_type AS event, count(*) AS events FROM events GROUP BY 1")
def s22_appended_events(spark, d):
    at = _folder(spark, "events")
    events = views.v_events(spark, d)
    for k in (0, 1):
        sinks.append_events(events.filter(F.col("seq") % 2 == k), at)
    return runs.event_outcome_counts(spark.read.json(at))


# records

STORE = "WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'entry' WHEN event_id % 13 = 0 THEN 'negative' ELSE 'entry' END AS kind, event_id % 5 = 0 AS fresh FROM events)"


def _upserted(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_id").cast("string").alias("pdb_id"), F.when(F.col("event_id") % 13 == 0, "negative").otherwise("entry").alias("kind"), F.lit(False).alias("fresh"))
    new = e.filter("pdb_id % 5 = 0").withColumns({"kind": F.lit("entry"), "fresh": F.lit(True)})
    at = _folder(spark, "store")
    sinks.write_metadata_records(e, new, at)
    return spark.read.parquet(at)


@query(STORE + " SELECT event_id::VARCHAR AS pdb_id, kind, fresh FROM s")
def s23_metadata_records(spark, d):
    return _upserted(spark, d)


@query(STORE + " SELECT count(*) FILTER (WHERE kind = 'negative') AS removed FROM s")
def s24_clear_negative(spark, d):
    return selection.clear_negative(_upserted(spark, d))[1]


@query(STORE + " SELECT kind, count(*) AS records FROM s GROUP BY 1")
def a25_store_inspect(spark, d):
    return selection.store_inspect(_upserted(spark, d))


@query(EV + " SELECT section, count(*) AS removed FROM v WHERE source::INT % 7 = 0 GROUP BY 1")
def s25_drop_sources(spark, d):
    events = views.v_events(spark, d)
    return runs.drop_sources(events, events.filter(F.col("source").cast("int") % 7 == 0))[1]


@query(EV + ", l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY (section = 'planned')::INT, seq DESC) = 1) SELECT count(*) FILTER (WHERE section='results') AS num_processed, count(*) FILTER (WHERE section='errors') AS num_failed, count(*) FILTER (WHERE section='skipped') AS num_skipped, count(*) FILTER (WHERE section='planned') AS num_planned, num_failed = 0 AS ok FROM l")
def p10_summarize_run(spark, d):
    return runs.summarize_run(views.v_events(spark, d))[1]


@query(EV + " SELECT seq, source, CASE WHEN source::INT % 3 = 0 THEN 'c' || c_custkey END AS tag FROM v LEFT JOIN customer ON c_custkey = source::INT AND source::INT % 3 = 0")
def j20_enrich_entries(spark, d):
    c = views.table(spark, d, "customer").filter("c_custkey % 3 = 0")
    meta = c.select(F.col("c_custkey").cast("string").alias("source"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tag"))
    return runs.enrich_entries(views.v_events(spark, d), meta).select("seq", "source", "tag")


@query("SELECT p_partkey AS rep_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j24_download_plan(spark, d):
    have = views.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("pdb_id"), F.lit("x").alias("path")).distinct()
    return selection.download_plan(views.table(spark, d, "part").select(F.col("p_partkey").alias("rep_id")), have)


@query("""WITH c AS (SELECT o_orderkey AS key, unnest([o_custkey, o_custkey + 1, o_custkey + 2]) AS path, unnest([0, 1, 2]) AS ord FROM orders), l AS (SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_tax > 0.07)
  SELECT key, coalesce(arg_min(c.path, ord) FILTER (WHERE l.path IS NOT NULL), arg_min(c.path, ord)) AS path FROM c LEFT JOIN l USING (path) GROUP BY key""")
def x21_resolve_path(spark, d):
    raw = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.array(*[F.col("o_custkey") + k for k in range(3)]).alias("candidates"))
    there = views.table(spark, d, "lineitem").filter("l_tax > 0.07").select(F.col("l_partkey").alias("path"))
    return runs.resolve_paths(raw, there).select("key", "path")


@query("SELECT o_orderkey AS structure_id, 'o' || o_orderkey AS source_label FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderkey % 20) / 20 <= 0.5")
def f19_run_filter(spark, d):
    return catalog.filtered(views.v_structures(spark, d), run_id="1-URGENT", frac_coil_max=0.5).select(SID, "source_label")


@query("SELECT o_orderkey AS structure_id, 'mmcif' AS format, CASE WHEN o_orderkey % 10 <> 0 THEN '/v/structure/' || o_orderkey END AS url FROM orders")
def j15_viewer_record(spark, d):
    rows = views.v_structures(spark, d).join(views.v_renders(spark, d), SID)
    return catalog.viewer_record(rows, "/v").select(SID, "format", F.col("urls.structure").alias("url"))


@query("SELECT o_orderkey AS structure_id, 'render' AS action FROM orders WHERE o_orderkey % 10 <> 0 AND (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND (o_orderkey % 5 = 0 OR o_orderkey % 3 <> 1))) ORDER BY 1 LIMIT 500")
def o11_render_limit(spark, d):
    return catalog.plan_renders(views.v_structures(spark, d), views.v_renders(spark, d), "h1", limit=500).filter("action = 'render'").select(SID, "action")


@query(r"""SELECT event_id, CASE lower(replace(trim(event_type), '_', '-')) WHEN 'xray' THEN 'xray' WHEN 'em' THEN 'em' END AS method, TRY_CAST(nullif(regexp_extract('HTTP ' || (event_id % 700) || ' x', '\b([1-5][0-9]{2})\b', 1), '') AS INT) AS code,
  CASE WHEN regexp_matches('E' || event_id, '^[A-Z0-9]{4}$') THEN 'E' || event_id WHEN regexp_matches(upper(event_type), '^[A-Z0-9]{4}$') THEN upper(event_type) END AS id FROM events""")
def x06_record_scalars(spark, d):
    e = views.table(spark, d, "events")
    message = F.concat(F.lit("HTTP "), (F.col("event_id") % 700).cast("string"), F.lit(" x"))
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    return e.select("event_id", text.method_alias(F.col("event_type")).alias("method"), text.negative_record(own, message)["status_code"].alias("code"), text.infer_id(own, F.col("event_type"), F.lit("no id")).alias("id"))


# atoms

ATOM_SQL = "WITH a AS (SELECT label::BIGINT AS structure_id, vec_id AS atom_seq, ['C','N','O','S','H'][vec_id % 5 + 1] AS element, ['ALA','GLY','HUB','HOH'][vec_id % 4 + 1] AS res_name, chr((65 + vec_id % 3)::INT) AS chain_id, vec_id % 40 AS res_id, (1 + vec_id % 2)::INT AS model, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _atoms(spark, d):
    k = F.col("vec_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    at = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    return views.table(spark, d, "embeddings").select(F.col("label").cast("long").alias(SID), k.alias("atom_seq"), pick("CNOSH").alias("element"), pick(["ALA", "GLY", "HUB", "HOH"]).alias("res_name"), pick("ABC").alias("chain_id"), (k % 40).alias("res_id"), (1 + k % 2).cast("int").alias("model"), *at)


@query(ATOM_SQL + " SELECT structure_id, atom_seq, element FROM a WHERE res_name IN ('ALA','GLY') AND element <> 'H' AND model = (SELECT min(model) FROM a b WHERE b.structure_id = a.structure_id)")
def f01_clean_atoms(spark, d):
    return prep.drop_hydrogens(prep.keep_amino_acids(prep.select_models(_atoms(spark, d), keep_all=False))).select(SID, "atom_seq", "element")


@query(ATOM_SQL + " SELECT structure_id, count(*) AS atoms FROM a WHERE res_name <> 'HUB' GROUP BY 1")
def f06_drop_hub_atoms(spark, d):
    return prep.drop_hub_atoms(_atoms(spark, d)).groupBy(SID).agg(F.count(F.lit(1)).alias("atoms"))


@query(ATOM_SQL + " SELECT atom_seq, CASE element WHEN 'C' THEN 1.70 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'S' THEN 1.80 ELSE 1.11 END::DOUBLE AS radius FROM a")
def j01_with_radius(spark, d):
    return prep.with_radius(_atoms(spark, d)).select("atom_seq", "radius")


@query(ATOM_SQL + """, b AS (SELECT *, (chain_id <> lag(chain_id) OVER w)::INT AS turn, (res_id - lag(res_id) OVER w < -10)::INT AS fell FROM a WINDOW w AS (PARTITION BY structure_id ORDER BY atom_seq))
  SELECT atom_seq, sum(coalesce(turn, 0)) OVER w AS block, (sum(coalesce(fell, 0)) OVER w)::INT AS copy FROM b WINDOW w AS (PARTITION BY structure_id ORDER BY atom_seq)""")
def w04_chain_blocks(spark, d):
    return prep.residue_reset_split(prep.chain_blocks(_atoms(spark, d))).select("atom_seq", "block", "copy")


@query(ATOM_SQL + """, c AS (SELECT structure_id, avg(x) mx, avg(y) my, avg(z) mz FROM a GROUP BY 1)
  SELECT structure_id, count(*) AS n, round(sum((x-mx)*(x-mx)), 6) AS xx, round(sum((x-mx)*(y-my)), 6) AS xy, round(sum((y-my)*(z-mz)), 6) AS yz, round(sum((z-mz)*(z-mz)), 6) AS zz FROM a JOIN c USING (structure_id) GROUP BY 1""")
def a06_scatter_matrix(spark, d):
    return geometry.scatter_matrix(_atoms(spark, d), [SID]).select(SID, "n", *[F.round(c, 6).alias(c) for c in ("xx", "xy", "yz", "zz")])


@query(ATOM_SQL + " SELECT structure_id, count(*) FILTER (WHERE element='C') / count(*) AS frac_alpha, count(*) FILTER (WHERE element='N') / count(*) AS frac_beta, count(*) FILTER (WHERE element='O') / count(*) AS frac_coil FROM a WHERE element IN ('C','N','O') GROUP BY 1")
def a16_sse_fractions(spark, d):
    sse = F.element_at(F.create_map(*[F.lit(v) for pair in zip("CNO", "abc") for v in pair]), F.col("element"))
    return sequences.sse_fractions(_atoms(spark, d).withColumn("sse", sse))


@query(ATOM_SQL + ", o AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, -1.0, 5.0)) t(copy, s, m)) SELECT atom_seq, copy::INT AS copy, round(x * s + m, 6) AS x, round(y * s, 6) AS y, round(z, 6) AS z FROM a, o WHERE chain_id <> 'C'")
def j03_expand_assembly(spark, d):
    atoms = _atoms(spark, d)
    ids = atoms.select(SID).distinct()
    turn = lambda s: F.array(*[F.lit(float(v)) for v in (s, 0, 0, 0, s, 0, 0, 0, 1)])
    op = lambda name, s, m: F.struct(F.lit(name).alias("oper_id"), turn(s).alias("matrix"), F.array(F.lit(m), F.lit(0.0), F.lit(0.0)).alias("shift"))
    oper = ids.select(SID, F.explode(F.array(op("1", 1, 0.0), op("2", -1, 5.0))).alias("o")).select(SID, "o.*")
    gen = ids.select(SID, F.lit("1").alias("assembly_id"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("oper_id")).select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("chain_id"))
    return prep.expand_assembly(atoms, gen, oper).select("atom_seq", "copy", *[F.round(c, 6).alias(c) for c in "xyz"])


# volumes

VOLS = "WITH v AS (SELECT l_orderkey AS structure_id, CASE l_returnflag WHEN 'N' THEN 'pore' WHEN 'R' THEN 'pocket' ELSE 'hub' END AS type, l_extendedprice AS volume, l_partkey AS comp, l_quantity AS q FROM lineitem)"


def _volumes(spark, d, *more):
    kind = F.when(F.col("l_returnflag") == "N", "pore").when(F.col("l_returnflag") == "R", "pocket").otherwise("hub")
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(SID), kind.alias("type"), kind.alias("final_type"), F.col("l_extendedprice").alias("volume"), F.col("l_partkey").alias("comp"), F.col("l_quantity").alias("num_voxels"), *more)


@query(VOLS + " SELECT structure_id, type, comp, volume, (row_number() OVER (PARTITION BY structure_id, type ORDER BY volume DESC, comp) - 1)::INT AS id FROM v WHERE volume >= 20000 AND q >= 5")
def w01_rank_volumes(spark, d):
    return metrics.rank_volumes(annotate.filter_by_volume(_volumes(spark, d), 20000, 5)).select(SID, "type", "comp", "volume", "id")


@query(VOLS + " SELECT structure_id, count(*) AS num_volumes, arg_max(type, volume) AS largest_type, max(volume) AS largest_volume FROM v WHERE type <> 'hub' GROUP BY 1")
def a15_largest_volume(spark, d):
    """Of equal volumes the first in the table wins, as arg_max takes them in order."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return annotate.largest_volume(annotate.drop_hubs(_volumes(spark, d, *place)), ["file", "row"])


@query(VOLS + " SELECT type, round(sum(volume), 2) AS total, max(volume) AS largest, round(avg(volume), 6) AS mean FROM v GROUP BY 1")
def a11_volume_summary(spark, d):
    return metrics.volume_summary(_volumes(spark, d), ["type"]).select("type", F.round("total", 2).alias("total"), "largest", F.round("mean", 6).alias("mean"))


@query(VOLS + " SELECT structure_id, " + ", ".join(f"coalesce(round(sum(volume) FILTER (WHERE type='{k}'), 4), 0) AS {k}_total, coalesce(max(volume) FILTER (WHERE type='{k}'), 0) AS {k}_largest, count(*) FILTER (WHERE type='{k}') AS {k}_num" for k in ("cavity", "hub", "pocket", "pore")) + " FROM v GROUP BY 1")
def a12_rollup_by_type(spark, d):
    rolled = metrics.annotation_rollup(_volumes(spark, d))
    kinds = ("cavity", "hub", "pocket", "pore")
    return rolled.select(SID, *[c for k in kinds for c in (F.round(f"{k}_total", 4).alias(f"{k}_total"), f"{k}_largest", f"{k}_num")])


# surfaces

DIRECT = EXPOSED + COMPS + """,
cv AS (SELECT structure_id, comp, flat, vx, vy, vz FROM cc JOIN bur USING (structure_id, flat)),
sz AS (SELECT structure_id, comp FROM cv GROUP BY ALL HAVING count(*) > 4),
ds AS (SELECT cv.* FROM cv JOIN sz USING (structure_id, comp) JOIN bur USING (structure_id, flat, vx, vy, vz)
  WHERE vx=0 OR vy=0 OR vz=0 OR vx=nx-1 OR vy=ny-1 OR vz=nz-1 OR EXISTS (SELECT 1 FROM ex WHERE ex.structure_id=cv.structure_id AND ex.flat=cv.flat))"""


def _surface(spark, d):
    """(typed voxels, their direct surface)."""
    grids, occupied, buried = annotate.occupied_and_buried(views.v_points(spark, d), CFG)
    parts = settled(topology.voxel_components(buried))
    large = parts.groupBy(SID, "comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 4").select(SID, "comp")
    typed = settled(parts.join(large, [SID, "comp"], "left_semi"))
    return typed, settled(topology.direct_surface(typed, voxels.exposed_contacts(buried, occupied, grids), grids))


NEIGHBOR = f", nv AS (SELECT DISTINCT cv.* FROM ds, {STEPS}, cv WHERE cv.structure_id=ds.structure_id AND cv.comp=ds.comp AND cv.vx=ds.vx+dx AND cv.vy=ds.vy+dy AND cv.vz=ds.vz+dz AND NOT EXISTS (SELECT 1 FROM ds e WHERE e.structure_id=cv.structure_id AND e.flat=cv.flat))"


@query(DIRECT + NEIGHBOR + " SELECT structure_id, comp, flat FROM nv")
def j08_neighbor_surface(spark, d):
    typed, direct = _surface(spark, d)
    return topology.neighbor_surface(direct, typed).select(SID, "comp", "flat")


#: Adjacent direct voxels: faces, and edge diagonals with a middle voxel in the support.
EDGES = DIRECT + NEIGHBOR + """,
su AS (SELECT structure_id, comp, vx, vy, vz FROM ds UNION SELECT structure_id, comp, vx, vy, vz FROM nv),
pr AS (SELECT a.structure_id, a.comp, a.flat a, b.flat b, a.vx ax, a.vy ay, a.vz az, b.vx bx, b.vy by_, b.vz bz, abs(a.vx-b.vx)+abs(a.vy-b.vy)+abs(a.vz-b.vz) AS n FROM ds a JOIN ds b ON a.structure_id=b.structure_id AND a.comp=b.comp AND a.flat<b.flat
  AND abs(a.vx-b.vx)<=1 AND abs(a.vy-b.vy)<=1 AND abs(a.vz-b.vz)<=1),
ed AS (SELECT * FROM pr WHERE n = 1 OR (n = 2 AND EXISTS (SELECT 1 FROM su WHERE su.structure_id=pr.structure_id AND su.comp=pr.comp
  AND ((su.vx=bx AND su.vy=ay AND su.vz=az) OR (su.vx=ax AND su.vy=by_ AND su.vz=az) OR (su.vx=ax AND su.vy=ay AND su.vz=bz)) AND NOT (su.vx=ax AND su.vy=ay AND su.vz=az))))"""


@query(EDGES + " SELECT structure_id, comp, a, b FROM ed")
def j09_surface_edges(spark, d):
    typed, direct = _surface(spark, d)
    support = direct.unionByName(topology.neighbor_surface(direct, typed).select(*direct.columns))
    return topology.surface_edges(direct, support, "custom18").select(SID, "comp", "a", "b")


MOUTHS = EDGES + """, bo AS (SELECT structure_id, a, b FROM ed UNION SELECT structure_id, b, a FROM ed),
rm(structure_id, flat, other) AS (SELECT structure_id, flat, flat FROM ds UNION SELECT rm.structure_id, rm.flat, bo.b FROM rm JOIN bo ON bo.structure_id=rm.structure_id AND bo.a=rm.other),
mo AS (SELECT structure_id, flat, min(other) AS mouth FROM rm GROUP BY ALL)"""


def _mouths(spark, d):
    typed, direct = _surface(spark, d)
    support = direct.unionByName(topology.neighbor_surface(direct, typed).select(*direct.columns))
    return typed, direct, settled(topology.mouths(direct, support, "custom18"))


@query(MOUTHS + " SELECT structure_id, comp, mouth, size, row_number() OVER (PARTITION BY structure_id, comp ORDER BY size DESC, mouth)::INT AS place FROM (SELECT structure_id, comp, mouth, count(*) AS size FROM mo JOIN ds USING (structure_id, flat) GROUP BY ALL)")
def g02_mouths_by_size(spark, d):
    return topology.by_size(_mouths(spark, d)[2]).select(SID, "comp", "mouth", "size", "place")


@query(MOUTHS + f""", mv AS (SELECT mo.mouth, ds.* FROM mo JOIN ds USING (structure_id, flat))
  SELECT structure_id, comp, mouth, flat FROM mv UNION SELECT cv.structure_id, cv.comp, mouth, cv.flat FROM mv, {STEPS}, cv WHERE cv.structure_id=mv.structure_id AND cv.comp=mv.comp AND cv.vx=mv.vx+dx AND cv.vy=mv.vy+dy AND cv.vz=mv.vz+dz""")
def j10_mouth_shells(spark, d):
    typed, _, patches = _mouths(spark, d)
    return topology.mouth_shells(patches, typed).select(SID, "comp", "mouth", "flat")
