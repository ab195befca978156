"""Writing annotations, structures, catalogs, summaries and logs.

Every sink partitions by structure, run or section and leaves file commits to Spark;
lists of one structure are gathered in order inside an aggregation, those of a run are
written a line an entry.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from ..functions.text import atom_line
from ..operators.steps import settled
from .corpus import SECTIONS

SID = "structure_id"


def annotation_payload(annotations: DataFrame) -> DataFrame:
    """(structure_id, payload): one JSON object a structure, volumes in order."""
    order = F.struct(-F.col("volume"), "type", "id", F.struct("id", "type", "volume", "x", "y", "z", F.col("circularity").alias("cross_section_circularity"), F.col("uniformity").alias("cross_section_uniformity")).alias("v"))
    rows = annotations.groupBy(SID).agg(F.transform(F.sort_array(F.collect_list(order)), lambda o: o["v"]).alias("volumes"))
    largest = F.try_element_at("volumes", F.lit(1))
    return rows.select(SID, F.to_json(F.struct(F.col(SID).cast("string").alias("source"), F.size("volumes").alias("num_volumes"), largest["type"].alias("largest_type"), largest["volume"].alias("largest_volume"), "volumes")).alias("payload"))


def write_annotation_json(annotations: DataFrame, folder: str) -> None:
    annotation_payload(annotations).select(SID, F.col("payload").alias("value")).write.partitionBy(SID).mode("overwrite").text(folder)


def annotation_columns(annotations: DataFrame, order: Sequence[Column | str] | None = None) -> DataFrame:
    """(structure_id, payload): a JSON object of columns, each a map from row to value.
    Rows are numbered in ``order``, by default that of ``in_order``."""
    w = W.partitionBy(SID).orderBy(*(order or (F.desc("volume"), "type", "id")))
    rows = annotations.withColumn("row", (F.row_number().over(w) - 1).cast("string")).withColumnsRenamed({"circularity": "cross_section_circularity", "uniformity": "cross_section_uniformity"})
    names = ["id", "type", "volume", "x", "y", "z", "cross_section_circularity", "cross_section_uniformity"]
    columns = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("row", F.col(c).alias("v"))))).alias(c) for c in names]
    return rows.groupBy(SID).agg(*columns).select(SID, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("payload"))


def write_annotation_columnar(annotations: DataFrame, folder: str, order: Sequence[Column | str] | None = None) -> None:
    annotation_columns(annotations, order).select(SID, F.col("payload").alias("value")).write.partitionBy(SID).mode("overwrite").text(folder)


def pdb_lines(atoms: DataFrame, delimiter: str = "END") -> DataFrame:
    """(structure_id, part, idx, value): formatted ATOM lines of each part (the
    structure is 0, its volumes 1), a delimiter after each part."""
    w = W.partitionBy(SID, "part").orderBy("atom_seq")
    lines = atoms.withColumn("idx", F.row_number().over(w) - 1)
    lines = lines.select(SID, "part", "idx", atom_line(F.col("idx")).alias("value"))
    ends = lines.groupBy(SID, "part").agg((F.max("idx") + 1).alias("idx")).withColumn("value", F.lit(delimiter))
    return lines.unionByName(ends)


def write_annotated_pdb(atoms: DataFrame, folder: str, delimiter: str = "END") -> None:
    lines = pdb_lines(atoms, delimiter).repartition(F.col(SID)).sortWithinPartitions(SID, "part", "idx")
    lines.select(SID, "value").write.partitionBy(SID).mode("overwrite").text(folder)


def entity_types(atoms: DataFrame) -> DataFrame:
    """An entity is a polymer if any residue name is not a volume code."""
    from ..config import CHAINS

    return atoms.groupBy(SID, "entity_id").agg(F.when(F.bool_or(~F.col("res_name").isin(list(CHAINS))), "polymer").otherwise("non-polymer").alias("type"))


CIF_COLUMNS = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_entity_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_ins_code", "pdbx_PDB_model_num"]


def cif_value(value: Column) -> Column:
    """A value as a CIF word: bare, in quotes, or as a text field; ? for null and empty."""
    v = value.cast("string")
    bare = v.rlike(r"^[^\s_#$'\"\[\];]\S*$") & ~v.rlike("(?i)^(loop_|stop_|global_|data_|save_)") & ~v.isin("?", ".")
    line = ~v.contains("\n")
    return (
        F.when(v.isNull() | (v == ""), "?").when(bare, v).when(line & ~v.rlike("'\\s"), F.concat(F.lit("'"), v, F.lit("'")))
        .when(line & ~v.rlike('"\\s'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("\n;"), v, F.lit("\n;")))
    )



def cif_lines(atoms: DataFrame) -> DataFrame:
    """(structure_id, part, idx, value): data block, entity loop and atom_site loop. Chain
    ids keep all their letters. ``ins_code`` and ``model`` may be left out of ``atoms``."""
    # entities in the order of numbers, then of texts
    number_of = F.col("chain_id").try_cast("int")
    entity = F.dense_rank().over(W.partitionBy(SID).orderBy(number_of.isNull(), number_of, "chain_id"))
    rows = atoms.withColumns({"entity_id": entity, "idx": F.row_number().over(W.partitionBy(SID).orderBy("part", "atom_seq"))})
    number = lambda c: F.format_string("%.3f", c)
    values = ["group_pdb", "idx", "element", "atom_name", "res_name", "chain_id", "entity_id", "res_id"]
    more = [cif_value(F.col(c)) if c in atoms.columns else F.lit(other) for c, other in (("ins_code", "?"), ("model", "1"))]
    site = rows.select(SID, F.lit(3).alias("part"), "idx", F.concat_ws(" ", *[cif_value(F.col(v)) for v in values], *[number(c) for c in "xyz"], F.format_string("%.2f", "b_factor"), *more).alias("value"))
    kinds = entity_types(rows).select(SID, F.lit(1).alias("part"), (F.col("entity_id") + 10).alias("idx"), F.concat_ws(" ", F.col("entity_id").cast("string"), "type").alias("value"))
    heads = [(0, ["data_structure", "loop_", "_entity.id", "_entity.type"]), (2, ["loop_", *[f"_atom_site.{c}" for c in CIF_COLUMNS]])]
    fixed = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).alias("idx"), F.lit(v).alias("value")) for p, lines in heads for i, v in enumerate(lines)])
    head = atoms.select(SID).distinct().select(SID, F.explode(fixed).alias("h")).select(SID, "h.part", F.col("h.idx").cast("int").alias("idx"), "h.value")
    return site.unionByName(kinds).unionByName(head)


def write_annotated_cif(atoms: DataFrame, folder: str) -> None:
    # dealt by a hash of the id: by the id itself Spark leaves the exchange out, as all parts
    # of the union lie by id, and then merges partitions of each part by itself
    lines = cif_lines(atoms).repartition(F.xxhash64(SID)).sortWithinPartitions(SID, "part", "idx")
    lines.select(SID, "value").write.partitionBy(SID).mode("overwrite").text(folder)


def write_catalog(tables: dict[str, DataFrame], folder: str, run_id: str, replace: bool = False) -> None:
    """The tables of one run in partitions by run; a run that exists is an error
    unless it is replaced."""
    runs = tables["runs"]
    spark = runs.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs/run_id={run_id}")
    if not replace and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise ValueError(f"run {run_id!r} is already indexed")
    for name, df in tables.items():
        marked = df.withColumn("run_id", F.lit(run_id))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{name}")


def write_document(path: str, head: dict, entries: DataFrame, sections: list[str], compression: str | None = None) -> None:
    """One JSON object in a folder: the fields of ``head``, then each section as a list.
    ``entries``: section, ord, entry (a struct, or JSON of one line). Every entry is a line,
    and the lines are dealt to files by ranges, so the files in the order of their names are
    the document (a short one is one file) and no task holds it. Entries equal in ``ord``
    are ordered by their JSON; sections without entries are empty lists, others are left
    out. Entries take one exchange, and become JSON after it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    entries = entries.select(rank.cast("long").alias("rank"), "ord", "entry").filter("rank > 0")
    kinds = {f.name: f.dataType for f in entries.schema}
    value = F.to_json("entry") if isinstance(kinds["entry"], StructType) else F.col("entry")
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    first = settled(entries.groupBy("rank").agg(F.min(F.struct("ord", value.alias("value"))).alias("first")))  # a row a section
    known = entries.join(F.broadcast(first), "rank")
    leads = F.col("ord").eqNullSafe(F.col("first.ord")) & value.eqNullSafe(F.col("first.value"))
    # the first entry stands without a comma, its equals with one
    copies = known.filter(leads).groupBy("rank").agg(F.first("first.value").alias("value"), F.count(F.lit(1)).alias("n"))
    copies = copies.select("rank", F.lit(1).alias("step"), none("ord"), none("entry"), F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: F.concat(F.when(k == 1, "").otherwise(","), F.col("value")))).alias("line"))
    rest = known.filter(~leads).select("rank", F.lit(2).alias("step"), "ord", "entry", F.lit(None).cast("string").alias("line"))
    fixed = [(0, 0, json.dumps(head, separators=(",", ":"))[:-1])]
    for k, s in enumerate(sections, 1):
        fixed += [(k, 0, f'{"," if head or k > 1 else ""}"{s}":['), (k, 3, "]")]
    frame = entries.sparkSession.createDataFrame([*fixed, (len(sections) + 1, 0, "}")], "rank long, step int, line string")
    whole = rest.unionByName(copies).unionByName(frame.select("rank", "step", none("ord"), none("entry"), "line"))
    line = F.coalesce("line", F.concat(F.lit(","), value))
    dealt = whole.repartitionByRange("rank", "step", "ord", line).select("rank", "step", "ord", line.alias("value"))
    out = dealt.sortWithinPartitions("rank", "step", "ord", "value").select("value").write.mode("overwrite")
    (out.option("compression", compression) if compression else out).text(path)


def _sizes(entries: DataFrame, sections: list[str]) -> dict[str, int]:
    """Entries of each section; the driver sees a row a section."""
    return {r.section: r.n for r in entries.filter(F.col("section").isin(sections)).groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}


def write_run_summary(entries: DataFrame, path: str, config: dict[str, str] | None = None, compression: str | None = None) -> None:
    """The run summary with its counts and four sections. ``entries``: section, ord and
    the entry's columns. ``compression``: of the files, such as gzip."""
    fields = [c for c in entries.columns if c not in ("section", "ord", "seq")]
    sizes = _sizes(entries, SECTIONS)
    counts = {n: sizes.get(s, 0) for s, n in zip(SECTIONS, ("num_processed", "num_failed", "num_skipped", "num_planned"))}
    write_document(path, {"config": config or {}, **counts}, entries.select("section", "ord", F.struct(*fields).alias("entry")), SECTIONS, compression)


def write_manifest(selected: DataFrame, path: str, rejected: DataFrame | None = None, command: str = "select") -> None:
    """A manifest of the structures (ord, source, pdb_id, input_path,
    cluster_member_pdb_ids) and rejections (rep_id, reason; by both)."""
    fields = ["source", "pdb_id", "input_path", "cluster_member_pdb_ids"]
    entries = selected.select(F.lit("structures").alias("section"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*fields)).alias("entry"))
    head = {"manifest_format": "manifest-1", "source_command": command, "summary": {"num_structures": selected.count()}}
    sections = ["structures"]
    if rejected is not None:
        sections.append("rejections")
        entries = entries.unionByName(rejected.select(F.lit("rejections").alias("section"), F.lit(0).cast("long").alias("ord"), F.to_json(F.struct("rep_id", "reason")).alias("entry")))
    write_document(path, head, entries, sections)


def write_failures_manifest(entries: DataFrame, path: str) -> None:
    from ..operators.runs import failures

    rows = failures(entries)
    if "cluster_member_pdb_ids" not in rows.columns:
        rows = rows.withColumn("cluster_member_pdb_ids", F.array().cast("array<string>"))
    write_manifest(rows, path, command="failures")


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def write_metadata_records(store: DataFrame, new: DataFrame, folder: str) -> None:
    """The store with new records in place of old ones, written beside what is read."""
    from ..operators.selection import upsert_metadata

    upsert_metadata(store, new).write.mode("overwrite").parquet(folder)


