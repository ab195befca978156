"""The driver's tables seen as points, structures, volumes, runs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_points(spark, d) -> DataFrame:
    e = F.col("embedding")
    each = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("structure_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    at = lambda i: F.get(e, F.col("k") * 3 + i).cast("double")
    return each.select("structure_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.element_at(F.array(*map(F.lit, "CNOS")), (F.col("vec_id") % 4 + 1).cast("int")).alias("element"))


def code4(c) -> F.Column:
    return F.lpad(F.hex(c % 65536), 4, "0")


def v_structures(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("structure_id"), F.col("o_orderpriority").alias("run_id"), F.concat(F.lit("o"), k.cast("string")).alias("source_label"), code4(k).alias("pdb_id"),
        F.concat(F.lit("/in/"), k.cast("string"), F.lit(".cif")).alias("input_path"), F.when(k % 10 != 0, F.concat(F.lit("/s/"), k.cast("string"), F.lit(".cif"))).alias("annotated_cif_path"),
        F.lit(None).cast("string").alias("annotation_json_path"), (F.col("o_custkey") % 7).alias("num_chains"), F.col("o_custkey").alias("num_residues"), (F.col("o_custkey") % 4).alias("num_sequence_unique_chains"),
        (k % 100 / 100).alias("frac_alpha"), (k % 50 / 50).alias("frac_beta"), (k % 20 / 20).alias("frac_coil"),
    )


def v_volumes(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy(*[c for c in li.columns if c != "l_orderkey"])
    kind = F.when(F.col("l_returnflag") == "N", "pore").when(F.col("l_returnflag") == "R", "pocket").otherwise("cavity")
    return li.select(
        F.col("l_orderkey").alias("structure_id"), F.row_number().over(w).alias("ord"), kind.alias("type"), F.col("l_extendedprice").alias("volume"), F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), F.col("l_discount").alias("circularity"), F.col("l_tax").alias("uniformity"),
    )


def v_renders(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").select(k.alias("structure_id"), none.alias("x_png_path"), none.alias("y_png_path"), none.alias("z_png_path"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("render_style_hash"), status.alias("render_status"), (k % 5 != 0).alias("outputs_exist"))


def v_aliases(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"), code4(F.col("l_partkey") * 37).alias("alias_pdb_id")).distinct()


def v_entry_meta(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    method = F.when(F.col("event_type") == "purchase", "x-ray diffraction").when(F.col("event_type") == "click", "Electron Microscopy").otherwise("Solution NMR")
    return table(spark, d, "events").select(
        F.col("event_id").alias("entry"), F.array(F.struct(method.alias("method"))).alias("exptl"),
        F.struct(F.when(F.col("event_id") % 11 != 0, F.array((k / 10).cast("string"), F.lit("n/a"))).alias("resolution_combined"), F.floor("value").cast("string").alias("deposited_polymer_monomer_count")).alias("rcsb_entry_info"),
    )


def v_events(spark, d) -> DataFrame:
    section = F.when(F.col("event_id") % 4 == 0, "planned").when(F.col("event_id") % 4 == 1, "errors").when(F.col("event_id") % 4 == 2, "skipped").otherwise("results")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), section.alias("section"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), "ts", F.concat(F.lit("/in/"), (F.col("event_id") % 7).cast("string")).alias("input_path"))


def v_chains(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.expr("conv_id div 4").alias("structure_id"), F.col("conv_id").cast("string").alias("chain_id"), F.col("turn").alias("atom_seq"), F.expr("turn div 2").cast("int").alias("res_id"), F.lit("").alias("ins_code"), F.substring("role", 1, 3).alias("res_name"),
    )


def v_lines(spark, d) -> DataFrame:
    """Lines of eight parts; every ninth token is invalid, some repeat a representative."""
    p = F.col("p_partkey")
    token = F.when(p % 9 == 0, F.concat(F.lit("AF_"), p.cast("string"))).otherwise(F.concat(code4(p % 97 * 211), F.lit("_"), (p % 3).cast("string")))
    parts = table(spark, d, "part").select(F.expr("p_partkey div 8").alias("line"), p.alias("k"), token.alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"])
    return parts.groupBy("line").agg(F.concat_ws(" ", listed).alias("value"))


def v_bytes(spark, d) -> DataFrame:
    body = F.coalesce("html", F.lit(""))
    marked = F.when(F.col("page_id") % 17 == 0, F.concat(body, F.expr("char(1)"))).when(F.col("page_id") % 13 == 0, "").otherwise(body)
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), marked.cast("binary").alias("content"))


def v_bench(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_type").alias("case_name"), F.col("event_id").alias("seq"), F.col("value").alias("elapsed_seconds"), (F.col("user_id") * 1024).alias("max_rss_kb"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("largest_type"),
        F.create_map(F.concat(F.lit("s"), (k % 5).cast("string")), F.col("value") / 2).alias("stages"),
    )
