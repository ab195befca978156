"""Run, metadata and cluster files as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.steps import running, settled

ENTRY = (
    "source string, pdb_id string, input_path string, structure_output string, annotation_output string, reason string, error string, error_type string, "
    "num_volumes long, largest_type string, largest_volume double, actual_residues long, max_residues long, assembly_policy string, cluster_member_pdb_ids array<string>"
)
VOLUME = "id int, type string, volume string, x string, y string, z string, cross_section_circularity string, cross_section_uniformity string"
PAYLOAD = f"source string, input_path string, output_structure_cif string, num_volumes long, frac_alpha double, frac_beta double, frac_coil double, volumes array<struct<{VOLUME.replace(' ', ':').replace(',:', ',')}>>"
META = "exptl array<struct<method:string>>, rcsb_entry_info struct<resolution_combined:array<string>,deposited_polymer_monomer_count:string>"
SECTIONS = ["results", "errors", "skipped", "planned"]


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _whole(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def scan_cluster_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) in file order; blank lines count but are left out. Lines are numbered
    by ranges of (file, block), so a large file isn't one task's."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim("value", F.lit("\r")).alias("value")
    )
    numbered = running(lines, ["file", "block", "at"], F.lit(1), "n")
    per = numbered.groupBy("file").agg((F.min("n")).alias("_from"))
    return numbered.join(per, "file").filter(F.trim("value") != "").select((F.col("n") - F.col("_from")).cast("int").alias("line"), "value")


def scan_metadata_store(spark: SparkSession, folder: str) -> DataFrame:
    """pdb_id, kind, exptl, rcsb_entry_info of the records; files with a bad name or
    bad JSON are left out, undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    shape = f"metadata_record_format string, pdb_id string, kind string, entry_metadata struct<{META.replace(' ', ':', 1).replace(', rcsb_entry_info ', ',rcsb_entry_info:')}>, negative_entry struct<status_code:int,error:string>"
    read = files.select(F.upper(stem(F.col("path"))).alias("name"), F.from_json(F.decode("content", "UTF-8"), shape).alias("r"))
    return read.filter(F.col("name").rlike("^[A-Z0-9]{4}$") & F.col("r.kind").isNotNull()).select(F.col("name").alias("pdb_id"), "r.kind", "r.entry_metadata.exptl", "r.entry_metadata.rcsb_entry_info", "r.negative_entry")


def scan_annotations(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """One row a volume with the payload's own columns; ``ord`` is its place. A file is
    one object, or with ``lines`` one object a line."""
    read = spark.read.schema(PAYLOAD).option("multiLine", not lines).json(paths)
    flat = read.select(F.coalesce("source", F.lit("structure")).alias("source"), "input_path", *[f"frac_{f}" for f in ("alpha", "beta", "coil")], F.posexplode_outer("volumes").alias("ord", "v"))
    return flat.select("source", "input_path", "frac_alpha", "frac_beta", "frac_coil", "ord", "v.id", "v.type", "v.volume", "v.x", "v.y", "v.z", F.col("v.cross_section_circularity").alias("circularity"), F.col("v.cross_section_uniformity").alias("uniformity"))


def scan_annotations_columnar(spark: SparkSession, paths) -> DataFrame:
    """JSON of columns, each a map from row key to value. Six columns are needed, else
    the file has no rows; keys are ordered as numbers, then as text."""
    need, other = ["id", "type", "volume", "x", "y", "z"], ["cross_section_circularity", "cross_section_uniformity"]
    whole = _whole(spark, paths).select(stem(F.col("path")).alias("source"), F.from_json("value", "map<string,map<string,string>>").alias("m"))
    whole = whole.filter(F.size(F.array_intersect(F.map_keys("m"), F.array(*[F.lit(c) for c in need]))) == len(need))
    # the cells of a row side by side, by one look at each; the maps don't go along with rows
    column = lambda c: F.try_element_at(F.col("m"), F.lit(c))
    cells = F.transform_values(column("type"), lambda _, v: F.array(v))
    names = ["type", *[c for c in need + other if c != "type"]]
    for c in names[1:]:
        cells = F.map_zip_with(cells, F.coalesce(column(c), F.create_map().cast("map<string,string>")), lambda _, row, v: F.concat(row, F.array(v)))
    keyed = whole.select("source", F.explode(cells).alias("key", "row")).filter("row is not null")
    cell = lambda c: F.get("row", F.lit(names.index(c)))
    return keyed.select(
        "source", "key", cell("id").try_cast("int").alias("id"), cell("type").alias("type"), *[cell(c).try_cast("double").alias(c) for c in ("volume", "x", "y", "z")],
        *[cell(c).try_cast("double").alias(c.removeprefix("cross_section_")) for c in other],
    )


def row_key_order(key: str = "key") -> list[Column]:
    number = F.col(key).try_cast("int")
    return [number.isNull(), number, F.col(key)]


def _places(spark: SparkSession) -> Callable[..., Column]:
    """The place of each row, from 0, among those of its (file, block) in the task."""

    @F.pandas_udf("long")
    def place(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, n = None, 0
        for file, block in pairs:
            keys = np.stack([file.to_numpy(), block.to_numpy()], 1)
            new = np.flatnonzero(np.concatenate(([tuple(keys[0]) != last], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else np.zeros(0, int)
            at = np.arange(n, n + len(keys))
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(keys)]):
                at[lo:hi] = np.arange(hi - lo)
            if len(keys):
                last, n = tuple(keys[-1]), int(at[-1]) + 1
            yield pd.Series(at)

    # as if not deterministic: else filters would be taken before it
    return place.asNondeterministic()


def document_entries(spark: SparkSession, path: str, sections: list[str], entry: str) -> DataFrame | None:
    """(section, ord, e, at) of a document that has each entry on a line, as the sinks
    write it; None if it is laid out otherwise. Rows of each block of a file are counted,
    and lines numbered where they are read, so there is no exchange of lines and the
    document is never in one task; the driver sees a row a section."""
    read = spark.read.text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    opens = F.regexp_extract("value", '^,?"([a-z_]+)":\\[$', 1)
    if lines.filter(opens.isin(sections)).isEmpty():
        return None
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_rows"))
    before = settled(sizes.select("file", "block", (F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy("file", "block")) - F.col("_rows")).alias("_before")))  # a row a block
    placed = lines.withColumn("_place", _places(spark)(F.xxhash64("file"), "block"))
    known = F.coalesce("_before", F.raise_error(F.concat(F.lit("the blocks of files changed while they were read: "), F.col("file"))).cast("long"))
    numbered = placed.join(F.broadcast(before), ["file", "block"], "left").select("file", "value", (known + F.col("_place") + 1).alias("n"))
    starts = sorted((r.n, r.section) for r in numbered.select("n", opens.alias("section")).filter(F.col("section").isin(sections)).collect())
    section, start = F.lit(None).cast("string"), F.lit(None).cast("long")
    for n, name in starts:  # the last that opens before a line
        section, start = F.when(F.col("n") > n, name).otherwise(section), F.when(F.col("n") > n, n).otherwise(start)
    listed = numbered.filter(F.col("value").startswith("{") | F.col("value").startswith(",{"))
    rows = listed.select(section.alias("section"), (F.col("n") - start - 1).cast("int").alias("ord"), F.from_json(F.ltrim("value", F.lit(",")), entry).alias("e"), F.col("file").alias("at"))
    return rows.filter("section is not null")


def scan_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """(section, ord, entry columns) of a run summary or checkpoint: one that the sinks
    wrote by its lines, any other as one JSON document."""
    rows = document_entries(spark, path, SECTIONS, ENTRY)
    if rows is not None:
        return rows.select("section", "ord", "e.*")
    fields = ENTRY.replace("array<string>", "ARRAY").replace(", ", ",").replace(" ", ":").replace("ARRAY", "array<string>")
    shape = ", ".join(f"{s} array<struct<{fields}>>" for s in SECTIONS)
    read = spark.read.schema(shape).option("multiLine", True).json(path)
    parts = [read.select(F.lit(s).alias("section"), F.posexplode(s).alias("ord", "e")).select("section", "ord", "e.*") for s in SECTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


scan_checkpoint = scan_run_summary
STRUCTURE = "source string, pdb_id string, input_path string, cluster_member_pdb_ids array<string>"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Structures of a manifest; a row without source or path is an error, relative
    paths start at the manifest's folder. Read as ``scan_run_summary`` reads."""
    read = document_entries(spark, path, ["structures", "rejections"], STRUCTURE)
    if read is not None:
        read = read.filter("section = 'structures'").select("at", "ord", F.col("e").alias("s"))
    else:
        shape = "structures array<struct<source:string,pdb_id:string,input_path:string,cluster_member_pdb_ids:array<string>>>"
        read = spark.read.schema(shape).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("at"), F.posexplode("structures").alias("ord", "s"))
    there = F.coalesce("s.source", "s.input_path").isNotNull() & F.col("s.input_path").isNotNull()
    checked = F.when(there & (F.length("s.input_path") > 0), F.col("s.input_path")).otherwise(F.raise_error(F.lit("manifest structure without input_path")))
    folder = F.regexp_extract("at", r"^(?:file:)?(.*)/[^/]*$", 1)
    full = F.when(checked.startswith("/") | checked.contains("://"), checked).otherwise(F.concat_ws("/", folder, checked))
    return read.select("ord", F.coalesce("s.source", stem(full)).alias("source"), "s.pdb_id", full.alias("input_path"), "s.cluster_member_pdb_ids")


def scan_status_records(spark: SparkSession, folder: str) -> DataFrame:
    """(source, record) of <label>.status.json files; empty or bad ones are ignored."""
    shape = "kind string, reason string, source string, assembly_policy string, input_path string, structure_output string, annotation_output string, actual_residues long"
    files = spark.read.option("pathGlobFilter", "*.status.json").text(folder, wholetext=True)
    return files.select(F.from_json("value", shape).alias("record")).filter("record.source is not null").select("record.source", "record")


def scan_bytes(spark: SparkSession, folder: str, glob: str = "*.cif") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def scan_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The catalog's six tables, also as views of their names."""
    out = {t: spark.read.parquet(f"{folder}/{t}") for t in ("runs", "structures", "structure_pdb_aliases", "volumes", "structure_aggregates", "renders")}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
