"""More queries over the driver's tables: presets, counters, chains of copies, structure
files, aligned points and an index that grows with a stream."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window as W, functions as F

from . import views
from .functions import geometry, sequences, text
from .operators import catalog, metrics, prep, runs, selection, topology, voxels
from .operators.steps import shared_dir
from .plans import annotate
from .registry import AGG, CFG, CHAIN, EV, EVENTS, LINES, SID, STORE, STR, VOL, _chosen, _plan, _tables, query
from .registry_more import ATOM_SQL, MOUTHS, _atoms
from .sources import corpus, sinks
from .sources.structures import scan_cif_atoms, scan_pdb
from .streaming import events as streams

# catalog

PRESET = ["num_chains", "num_residues", "num_sequence_unique_chains", "largest_pocket_volume_a3", "largest_pocket_max_diameter_a", "largest_pocket_length_a", "largest_pocket_circularity"]


@query(VOL + STR + AGG + f" SELECT structure_id, source_label, {', '.join(PRESET)} FROM st JOIN ag USING (structure_id) WHERE num_sequence_unique_chains <= 3 AND frac_coil <= 0.6")
def f37_preset_filter(spark, d):
    t = _tables(spark, d)
    return catalog.metric_columns(catalog.filtered(t["structures"].join(t["structure_aggregates"], SID), preset="Pockets"), "Pockets")


@query(EV + """, k AS (SELECT * FROM v WHERE section = 'results' OR (section = 'skipped' AND seq % 8 = 2))
  SELECT source, section, seq FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY (section <> 'results')::INT, seq) = 1""")
def e04_summary_entries(spark, d):
    reason = F.when(F.col("seq") % 8 == 2, "resume_existing_outputs").otherwise("other")
    return catalog.summary_entries(views.v_events(spark, d).withColumns({"ord": F.col("seq"), "reason": reason})).select("source", "section", "seq")


@query("SELECT c_nationkey AS structure_id, c_mktsegment AS type, c_custkey AS id, c_acctbal AS volume, c_acctbal * 2 AS y, c_acctbal * 5 AS uniformity FROM customer")
def a13_annotation_maps(spark, d):
    c = views.table(spark, d, "customer")
    more = {n: F.col("c_acctbal") * k for k, n in enumerate(("x", "y", "z", "circularity", "uniformity"), 1)}
    rows = c.select(F.col("c_nationkey").alias(SID), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("volume"), *[v.alias(n) for n, v in more.items()])
    each = metrics.annotation_maps(rows).select(SID, "type", "dimensions", "shapes", F.explode("volumes").alias("id", "volume"))
    at = lambda m, k: F.get(F.element_at(m, F.col("id")), F.lit(k))
    return each.select(SID, "type", "id", "volume", at("dimensions", 1).alias("y"), at("shapes", 1).alias("uniformity"))


@query("SELECT l_orderkey AS structure_id, l_partkey AS flat FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 25")
def f40_mouth_voxels(spark, d):
    code = F.when(F.col("l_returnflag") == "N", "POR").when(F.col("l_returnflag") == "R", "POK").otherwise("CAV")
    atoms = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(SID), F.col("l_partkey").alias("flat"), code.alias("res_name"), F.when(F.col("l_quantity") > 25, 50.0).otherwise(0.0).alias("b_factor"))
    return catalog.select_volume_atoms(atoms, "POR", "mouth").select(SID, "flat")


# selection and runs

WHY = ["experimental_method", "missing_resolution", "resolution", "residue_count", "metadata_negative", "metadata_missing"]


@query(STORE + " SELECT count(*) AS examined, count(*) FILTER (WHERE reason IS NULL) AS selected, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS rejected_{r}" for r in WHY)
       + ", count(*) FILTER (WHERE reason IS NULL OR reason NOT LIKE 'metadata%') AS metadata_hit, count(*) FILTER (WHERE reason = 'metadata_negative') AS metadata_negative, count(*) FILTER (WHERE reason = 'metadata_missing') AS metadata_miss FROM dc")
def a20_selection_counters(spark, d):
    return _chosen(spark, d)[2]


@query(STORE + " SELECT rep_id, rep_ord, reason FROM dc WHERE reason IS NOT NULL")
def e11_rejections(spark, d):
    return _chosen(spark, d)[1].select("rep_id", F.col("rep_ord").cast("long").alias("rep_ord"), "reason")


@query(LINES + " SELECT DISTINCT rep_id, rep_ord FROM mb WHERE rep_ord < 40")
def o04_cap_representatives(spark, d):
    reps = selection.parse_members(views.v_lines(spark, d)).select("rep_id", "rep_ord").distinct()
    return selection.cap_representatives(reps, 40).select("rep_id", F.col("rep_ord").cast("long").alias("rep_ord"))


KINDS = {"skipped_valid": "= 7", "skipped_terminal": "= 6", "reanalyze_partial": "= 1", "reanalyze_invalid": "IN (2, 3, 4, 5)"}


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE o_orderkey % 8 {k}) AS {n}" for n, k in KINDS.items()) + "".join(
    f", (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT 'o' || o_orderkey AS s FROM orders WHERE o_orderkey % 8 {k} ORDER BY s LIMIT 3)) AS {n}_samples" for n, k in KINDS.items() if n != "skipped_valid") + " FROM orders")
def a35_resume_counts(spark, d):
    counts = runs.resume_counts(_plan(spark, d))
    return counts.select(*KINDS, *[F.array_join(f"{n}_samples", ",").alias(f"{n}_samples") for n in KINDS if n != "skipped_valid"])


@query("SELECT 'planned' AS section, 'o' || o_orderkey AS source, '/in/o' || o_orderkey AS input_path, '/out/o' || o_orderkey || '.annotated.cif' AS structure_output, '/out/o' || o_orderkey || '.annotation.json' AS annotation_output FROM orders WHERE o_orderkey % 8 < 6")
def p09_plan_dry_run(spark, d):
    return runs.plan_dry_run(_plan(spark, d))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY TRY_CAST(k AS INT) IS NULL, TRY_CAST(k AS INT), k)::INT AS place FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'k' || event_id ELSE event_id::VARCHAR END AS k FROM events)")
def o07_row_key_order(spark, d):
    own = F.col("event_id").cast("string")
    rows = views.table(spark, d, "events").withColumn("key", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), own)).otherwise(own))
    return rows.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(*corpus.row_key_order())).alias("place"))


@query("SELECT user_id::VARCHAR AS source, min(event_id) AS first_event FROM events GROUP BY 1")
def t03_stream_index(spark, d):
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    feed = streams.event_stream(spark, d, EVENTS, "parquet", "events.parquet")
    first = lambda batch: batch.groupBy(F.col("user_id").cast("string").alias("source")).agg(F.min("event_id").alias("first_event"))
    streams.stream_index(feed, f"{at}/index", f"{at}/log", first, ["source"]).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/index").select("source", "first_event")


@query(r"""SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":"' || p_size || '"}'), 1, 16) AS style, ['mmcif','pdb','mmcif','pdb',NULL][(p_partkey % 5 + 1)::INT] AS format,
  coalesce(nullif(lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9_\-]+', '_', 'g'), '_')), ''), 'run') AS run_id FROM part""")
def x26_style_and_format(spark, d):
    p = views.table(spark, d, "part")
    suffix = F.element_at(F.array(*map(F.lit, [".cif", ".pdb", ".mmCIF", ".ent", ".gz"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    options = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return p.select("p_partkey", text.style_hash(options).alias("style"), text.structure_format(F.concat(F.lit("/a/b"), suffix)).alias("format"), text.derive_run_id(F.concat(F.lit("/x/"), "p_brand", F.lit("/run.json"))).alias("run_id"))


# structures

COPIES = VOL.replace("WITH v", "WITH RECURSIVE v", 1) + """,
c AS (SELECT structure_id, ord, CASE kind WHEN 'pore' THEN 'A' WHEN 'pocket' THEN 'B' ELSE 'C' END AS ch FROM v), t AS (SELECT *, lag(ch) OVER (PARTITION BY structure_id ORDER BY ord) AS was FROM c),
b AS (SELECT structure_id, ord, ch, (sum(coalesce(was <> ch, false)::INT) OVER (PARTITION BY structure_id ORDER BY ord))::BIGINT AS block FROM t), k AS (SELECT DISTINCT structure_id, block, ch FROM b),
f(structure_id, block, copy, seen) AS (SELECT structure_id, block, 0, [ch] FROM k WHERE block = 0
  UNION ALL SELECT k.structure_id, k.block, copy + list_contains(seen, ch)::INT, CASE WHEN list_contains(seen, ch) THEN [ch] ELSE list_append(seen, ch) END FROM f JOIN k ON k.structure_id = f.structure_id AND k.block = f.block + 1),
cp AS (SELECT b.structure_id, ord, ch, block, copy FROM b JOIN f USING (structure_id, block))"""


def _copies(spark, d):
    chain = F.when(F.col("type") == "pore", "A").when(F.col("type") == "pocket", "B").otherwise("C")
    rows = views.v_volumes(spark, d).select(SID, F.col("ord").alias("atom_seq"), chain.alias("chain_id"))
    return prep.copy_index(prep.chain_blocks(rows))


@query(COPIES + " SELECT structure_id, ord AS atom_seq, block, copy FROM cp")
def w05_copy_index(spark, d):
    return _copies(spark, d).select(SID, "atom_seq", "block", "copy")


@query(COPIES + f""", p AS (SELECT structure_id, copy, ch, min(ord) AS first FROM cp GROUP BY ALL), u AS (SELECT structure_id, list(DISTINCT ch) FILTER (WHERE copy = 0) AS used FROM p GROUP BY 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY copy, first) AS nth FROM p WHERE copy > 0)
  SELECT cp.structure_id, cp.ord AS atom_seq, coalesce([x for x in string_split('{prep.LETTERS}', '') if not list_contains(used, x)][nth], cp.ch) AS chain_id
  FROM cp JOIN u USING (structure_id) LEFT JOIN n ON n.structure_id = cp.structure_id AND n.copy = cp.copy AND n.ch = cp.ch""")
def w13_assign_chain_ids(spark, d):
    return prep.assign_chain_ids(_copies(spark, d)).select(SID, "atom_seq", "chain_id")


@query(f"""WITH u AS (SELECT l_orderkey AS structure_id, list(DISTINCT substr('ABCDEFGH', (l_partkey % 8 + 1)::INT, 1)) AS used FROM lineitem GROUP BY 1),
  w AS (SELECT structure_id, used, unnest(['HUB','POR','POK','CAV','OCC']) AS code, unnest(['A','B','C','D','E']) AS wish, unnest([1,2,3,4,5]) AS k FROM u),
  h AS (SELECT *, list_contains(used, wish) AS taken, sum(list_contains(used, wish)::INT) OVER (PARTITION BY structure_id ORDER BY k) AS n FROM w)
  SELECT structure_id, code, CASE WHEN taken THEN [x for x in string_split('{prep.LETTERS}', '') if not list_contains(used, x) and not list_contains(['A','B','C','D','E'], x)][n::BIGINT] ELSE wish END AS chain_id FROM h""")
def w14_volume_chain_ids(spark, d):
    chain = F.substring(F.lit("ABCDEFGH"), (F.col("l_partkey") % 8 + 1).cast("int"), F.lit(1))
    return prep.volume_chain_ids(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(SID), chain.alias("chain_id")))


@query("SELECT l_orderkey AS structure_id, l_orderkey % 5 <> 0 AND (l_orderkey % 3 <> 0 OR NOT bool_or(l_returnflag = 'R')) AS identity FROM lineitem GROUP BY 1")
def f34_identity_assembly(spark, d):
    atoms = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(SID), F.col("l_returnflag").alias("chain_id"))
    gen = atoms.filter(f"{SID} % 3 <> 0 or chain_id <> 'R'").distinct().select("*", F.lit("1").alias("assembly_id"), F.lit("1").alias("oper_id"))
    shift = F.array(F.when(F.col(SID) % 5 == 0, 2.0).otherwise(0.0), F.lit(0.0), F.lit(0.0))
    oper = atoms.select(SID).distinct().select(SID, F.lit("1").alias("oper_id"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("matrix"), shift.alias("shift"))
    return prep.identity_assembly(gen, oper, atoms)


@query("SELECT l_orderkey AS structure_id, l_linenumber % 2 AS entity_id, CASE WHEN bool_or(l_returnflag NOT IN ('N', 'R')) THEN 'polymer' ELSE 'non-polymer' END AS type FROM lineitem GROUP BY 1, 2")
def a29_entity_types(spark, d):
    name = F.when(F.col("l_returnflag") == "N", "POR").when(F.col("l_returnflag") == "R", "POK").otherwise("ALA")
    return sinks.entity_types(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(SID), (F.col("l_linenumber") % 2).alias("entity_id"), name.alias("res_name")))


@query(CHAIN + " SELECT structure_id, 'post_assembly_residue_limit' AS reason, count(*) AS actual_residues FROM b GROUP BY 1 HAVING count(*) > 8")
def f29_residue_limit(spark, d):
    return annotate.residue_limit_gate(views.v_chains(spark, d), 8)[1].select(SID, "reason", "actual_residues")


@query(ATOM_SQL + " SELECT 'A' || element AS atom_name, element, res_name, chain_id, res_id::INT AS res_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, (vec_id_ % 7)::DOUBLE AS b_factor FROM (SELECT *, atom_seq AS vec_id_ FROM a)")
def s15_pdb_files(spark, d):
    at = f"{shared_dir(spark)}/pdb-{uuid.uuid4().hex}"
    extra = {"atom_name": F.concat(F.lit("A"), "element"), "ins_code": F.lit(""), "b_factor": (F.col("atom_seq") % 7).cast("double"), "part": F.lit(0)}
    sinks.write_annotated_pdb(_atoms(spark, d).withColumns(extra), at)
    return scan_pdb(spark, f"{at}/*").select("atom_name", "element", "res_name", "chain_id", "res_id", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "b_factor")


@query(ATOM_SQL + """ SELECT 'HETATM' AS group_pdb, element, element || CASE atom_seq % 4 WHEN 0 THEN '1' || chr(39) WHEN 1 THEN ' b' WHEN 2 THEN '" ' || chr(39) || 'x' ELSE '' END AS atom_name, res_name, chain_id || 'aZ9' AS chain_id, res_id::INT AS res_id, CASE WHEN atom_seq % 3 = 0 THEN 'A' ELSE '' END AS ins_code, model,
  round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, (atom_seq % 7)::DOUBLE AS b_factor FROM a""")
def s02_cif_files(spark, d):
    """Atoms written as mmCIF, with blanks and quotes in names and chain ids of four
    letters, and read back."""
    at, k = f"{shared_dir(spark)}/cif-{uuid.uuid4().hex}", F.col("atom_seq")
    name = F.concat("element", F.when(k % 4 == 0, "1'").when(k % 4 == 1, " b").when(k % 4 == 2, "\" 'x").otherwise(""))
    extra = {"atom_name": name, "group_pdb": F.lit("HETATM"), "chain_id": F.concat("chain_id", F.lit("aZ9")), "ins_code": F.when(k % 3 == 0, "A").otherwise(""), "b_factor": (k % 7).cast("double"), "part": F.lit(0)}
    sinks.write_annotated_cif(_atoms(spark, d).withColumns(extra), at)
    found = scan_cif_atoms(spark, f"{at}/*")
    return found.select("group_pdb", "element", "atom_name", "res_name", "chain_id", "res_id", "ins_code", "model", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "b_factor")


@query(ATOM_SQL + """, m AS (SELECT structure_id, avg(x) mx, avg(y) my, avg(z) mz FROM a GROUP BY 1)
  SELECT structure_id, count(*) AS n, round(sum((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)), 5) AS spread, true AS falling, true AS principal FROM a JOIN m USING (structure_id) GROUP BY 1""")
def g07_aligned_spread(spark, d):
    """Turning to principal axes keeps the spread, puts it in falling order and leaves
    no covariance."""
    s = geometry.scatter_matrix(prep.align(_atoms(spark, d)), [SID])
    apart = F.abs("xy") + F.abs("xz") + F.abs("yz")
    return s.select(SID, "n", F.round(F.col("xx") + F.col("yy") + F.col("zz"), 5).alias("spread"), ((F.col("xx") >= F.col("yy") - 1e-9) & (F.col("yy") >= F.col("zz") - 1e-9)).alias("falling"), (apart < 1e-6).alias("principal"))


PAIRS = CHAIN + """, q AS (SELECT chain_id::BIGINT AS c, list(res_name ORDER BY turn) AS s FROM b GROUP BY 1), pr AS (SELECT x.c, CASE WHEN len(x.s) >= len(y.s) THEN x.s ELSE y.s END AS l, CASE WHEN len(x.s) >= len(y.s) THEN y.s ELSE x.s END AS t FROM q x JOIN q y ON y.c = x.c + 1 WHERE x.c % 2 = 0),
o AS (SELECT *, unnest(range(len(l) - len(t) + 1)) AS k FROM pr), m AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM o), n AS (SELECT c, k, len(l) AS size, count(*) FILTER (WHERE l[k + i] = t[i]) AS same FROM m GROUP BY ALL)"""


@query(PAIRS + " SELECT c AS pair, round(max(same) / max(size), 9) AS overlap FROM n GROUP BY 1")
def x20_sequence_overlap(spark, d):
    chains = sequences.chain_sequences(views.v_chains(spark, d)).withColumn("c", F.col("chain_id").cast("long"))
    even = chains.filter("c % 2 = 0").select(F.col("c").alias("pair"), F.col("sequence").alias("a"))
    odd = chains.filter("c % 2 = 1").select((F.col("c") - 1).alias("pair"), F.col("sequence").alias("b"))
    return even.join(odd, "pair").select("pair", F.round(sequences.sequence_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


#: Types of components by mouths and directions alone: no bridges, no necks.
TYPES = MOUTHS + """, nm AS (SELECT structure_id, comp, count(DISTINCT mouth) AS m, count(*) AS nd FROM mo JOIN ds USING (structure_id, flat) GROUP BY ALL),
al AS (SELECT structure_id, comp, count(*) AS n, avg(vx) AS cx, avg(vy) AS cy, avg(vz) AS cz FROM cc JOIN bur USING (structure_id, flat) GROUP BY ALL),
dd AS (SELECT structure_id, comp, vx - cx AS dx, vy - cy AS dy, vz - cz AS dz, greatest(abs(vx - cx), abs(vy - cy), abs(vz - cz)) AS far FROM ds JOIN al USING (structure_id, comp)),
bk AS (SELECT structure_id, comp, CASE WHEN abs(dx) = far THEN (dx >= 0)::INT WHEN abs(dy) = far THEN 2 + (dy >= 0)::INT ELSE 4 + (dz >= 0)::INT END AS side, count(*) AS c FROM dd GROUP BY ALL),
bs AS (SELECT structure_id, comp, list_reverse_sort(list(c)) AS l FROM bk GROUP BY 1, 2)"""


@query(TYPES + """ SELECT structure_id, comp, n AS num_voxels, coalesce(nd, 0) AS num_direct, coalesce(m, 0) AS num_mouths, CASE WHEN n <= 4 THEN 'occluded' WHEN nd IS NULL THEN 'cavity' WHEN m >= 3 THEN 'hub'
  WHEN m = 2 AND coalesce(l[5], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN m = 2 THEN 'pore' WHEN nd < 24 THEN 'pocket' WHEN coalesce(l[3], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN coalesce(l[2], 0) >= l[1] * 0.7::DOUBLE THEN 'pore' ELSE 'pocket' END AS type
  FROM al LEFT JOIN nm USING (structure_id, comp) LEFT JOIN bs USING (structure_id, comp)""")
def a10_types_by_direction(spark, d):
    plain = replace(CFG, merge_gap=-1, neck=False)
    grids, occupied, buried = annotate.occupied_and_buried(views.v_points(spark, d), plain)
    types, _ = topology.typed_components(topology.voxel_components(buried), occupied, grids, plain, voxels.exposed_contacts(buried, occupied, grids))
    return types.select(SID, "comp", "num_voxels", "num_direct", "num_mouths", "type")


@query(TYPES + """, ty AS (SELECT structure_id, comp, n, CASE WHEN n <= 4 THEN 'occluded' WHEN nd IS NULL THEN 'cavity' WHEN m >= 3 THEN 'hub'
  WHEN m = 2 AND coalesce(l[5], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN m = 2 THEN 'pore' WHEN nd < 24 THEN 'pocket' WHEN coalesce(l[3], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN coalesce(l[2], 0) >= l[1] * 0.7::DOUBLE THEN 'pore' ELSE 'pocket' END AS type
  FROM al LEFT JOIN nm USING (structure_id, comp) LEFT JOIN bs USING (structure_id, comp))
  SELECT structure_id, (row_number() OVER (PARTITION BY structure_id, type ORDER BY n DESC, comp) - 1)::INT AS id, type, round(n * 0.04::DOUBLE * 0.04 * 0.04, 9) AS volume FROM ty WHERE n >= 4 AND type <> 'occluded'""")
def p02_ranked_volumes(spark, d):
    plain = replace(CFG, merge_gap=-1, neck=False)
    return annotate.annotate_volumes(views.v_points(spark, d), plain)[0].select(SID, "id", "type", F.round("volume", 9).alias("volume"))
