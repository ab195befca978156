"""The catalog of structures and volumes: building, filtering, ranking, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text

KINDS = ["pore", "pocket", "cavity"]
PLURAL = {"pore": "pores", "pocket": "pockets", "cavity": "cavities", "hub": "hubs"}
METRICS = ["volume_a3", "length_a", "min_diameter_a", "max_diameter_a", "circularity", "uniformity"]

#: Column of each sort key, and the names by which keys may also be called.
SORT_COLUMNS = {c: c for c in ("structure_id", "source_label", "num_chains", "num_residues", "num_sequence_unique_chains", "frac_alpha", "frac_beta", "frac_coil")}
SORT_ALIASES = {}
for _k in KINDS:
    SORT_COLUMNS[f"num_{PLURAL[_k]}"] = f"num_{PLURAL[_k]}"
    for _m in METRICS:
        _short = _m.removesuffix("_a3").removesuffix("_a")
        SORT_COLUMNS[f"largest_{_k}_{_short}"] = f"largest_{_k}_{_m}"
        if _short != _m:
            SORT_ALIASES[f"largest_{_k}_{_m}"] = f"largest_{_k}_{_short}"

#: Column of each range filter; ``<name>_min`` and ``<name>_max`` are inclusive.
RANGES = {"chains": "num_chains", "residues": "num_residues", "seq_unique_chains": "num_sequence_unique_chains", **{f"frac_{f}": f"frac_{f}" for f in ("alpha", "beta", "coil")}}
for _k in KINDS:
    RANGES |= {f"num_{PLURAL[_k]}": f"num_{PLURAL[_k]}"} | {f"{_k}_{n}": f"largest_{_k}_{m}" for n, m in zip(("volume", "length", "dmin", "dmax", "circularity", "uniformity"), METRICS)}
#: Accepted and without effect: hubs are never indexed.
INERT = {f"hub_{n}" for n in ("volume", "length", "dmin", "dmax", "circularity", "uniformity")} | {"num_hubs"}

# Saved filters and column lists.
_SHARED = {"seq_unique_chains_max": 3, "frac_coil_max": 0.6}
FILTER_PRESETS = {
    "Pores": {**_SHARED, "pore_volume_min": 10000, "pore_dmin_min": 35, "pore_circularity_min": 0.8, "pore_uniformity_min": 0.5}, "Pockets": _SHARED, "Cavities": _SHARED,
}
_BASE = ["num_chains", "num_residues", "num_sequence_unique_chains"]
METRIC_PRESETS = {
    "Pores": _BASE + [f"largest_pore_{m}" for m in ("volume_a3", "min_diameter_a", "max_diameter_a", "uniformity", "circularity")],
    "Pockets": _BASE + [f"largest_pocket_{m}" for m in ("volume_a3", "max_diameter_a", "length_a", "circularity")],
    "Cavities": _BASE + [f"largest_cavity_{m}" for m in ("volume_a3", "max_diameter_a", "length_a", "circularity", "uniformity")],
}


def indexable(volumes: DataFrame) -> DataFrame:
    """Volumes of kinds that are indexed, with numeric volume; the lengths in falling
    order become length, largest and least diameter (null is 0). ``volumes``:
    structure_id, ord, type, volume, x, y, z, circularity, uniformity."""
    kind = F.lower(F.trim("type"))
    number = lambda c: F.col(c).try_cast("double")
    lengths = F.reverse(F.array_sort(F.array(*[F.coalesce(number(c), F.lit(0.0)) for c in "xyz"])))
    out = volumes.withColumns({"kind": kind, "volume_a3": number("volume"), "_l": lengths}).filter(F.col("kind").isin(KINDS) & F.col("volume_a3").isNotNull())
    return out.select(
        "structure_id", "ord", "kind", "volume_a3", F.col("_l")[0].alias("length_a"), F.col("_l")[2].alias("min_diameter_a"), F.col("_l")[1].alias("max_diameter_a"),
        number("circularity").alias("circularity"), number("uniformity").alias("uniformity"),
    )


def rank_in_kind(volumes: DataFrame) -> DataFrame:
    """``volumes`` with the rank from 1 in structure and kind; ties keep their order."""
    w = W.partitionBy("structure_id", "kind").orderBy(F.desc("volume_a3"), "ord")
    return volumes.withColumn("rank_in_kind", F.row_number().over(w))


def kind_aggregates(structures: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per structure and kind the number and the largest volume's metrics; hubs are 0
    and null. One aggregation over the volumes, no window."""
    aggs = []
    for k in KINDS:
        mine = F.col("kind") == k
        aggs.append(F.count_if(mine).alias(f"num_{PLURAL[k]}"))
        aggs.append(F.min_by(F.when(mine, F.struct(*METRICS)), F.when(mine, F.struct(-F.col("volume_a3"), F.col("ord")))).alias(f"_{k}"))
    top = volumes.groupBy("structure_id").agg(*aggs)
    wide = structures.select("structure_id").join(top, "structure_id", "left")
    columns = ["structure_id"]
    for k in KINDS:
        columns += [F.coalesce(f"num_{PLURAL[k]}", F.lit(0)).alias(f"num_{PLURAL[k]}"), *[F.col(f"_{k}.{m}").alias(f"largest_{k}_{m}") for m in METRICS]]
    columns += [F.lit(0).cast("long").alias("num_hubs"), *[F.lit(None).cast("double").alias(f"largest_hub_{m}") for m in METRICS]]
    return wide.select(*columns)


def range_filter(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    """Inclusive; null fails a bound."""
    if least is not None:
        df = df.filter(F.col(column) >= F.lit(least))
    if most is not None:
        df = df.filter(F.col(column) <= F.lit(most))
    return df


def sort_key(name: str, direction: str = "desc") -> list[Column]:
    """Order by a key, nulls last both ways, then by structure."""
    key = SORT_ALIASES.get(name, name)
    if key not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {name!r}; keys: {sorted(SORT_COLUMNS)}")
    if direction.lower() not in ("asc", "desc"):
        raise ValueError("sort direction must be asc or desc")
    column = F.col(SORT_COLUMNS[key])
    return [column.desc_nulls_last() if direction.lower() == "desc" else column.asc_nulls_last(), F.col("structure_id").asc()]


def catalog_join(structures: DataFrame, aggregates: DataFrame, renders: DataFrame) -> DataFrame:
    return structures.join(aggregates, "structure_id").join(renders, "structure_id", "left")


def id_contains(df: DataFrame, aliases: DataFrame | None, query: str) -> DataFrame:
    """Structures whose own id or any alias contains the text, without regard to case."""
    wanted = F.lit(query.strip().upper())
    own = F.upper(F.coalesce("pdb_id", F.lit(""))).contains(wanted)
    if aliases is None:
        return df.filter(own)
    hits = aliases.filter(F.upper("alias_pdb_id").contains(wanted)).select("structure_id").distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, "structure_id", "left").filter(own | F.col("_hit")).drop("_hit")


def filtered(df: DataFrame, aliases: DataFrame | None = None, run_id: str | None = None, pdb_id: str | None = None, preset: str | None = None, **ranges) -> DataFrame:
    """Rows within all bounds (``pore_volume_min=...``); unknown names are errors."""
    bounds = {**(FILTER_PRESETS[preset] if preset else {}), **{k: v for k, v in ranges.items() if v is not None}}
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    for name, value in bounds.items():
        base, _, side = name.rpartition("_")
        if side not in ("min", "max") or base not in RANGES and base not in INERT:
            raise ValueError(f"unknown filter {name!r}")
        if base in RANGES:
            df = range_filter(df, RANGES[base], value if side == "min" else None, value if side == "max" else None)
    return id_contains(df, aliases, pdb_id) if pdb_id and pdb_id.strip() else df


def query_catalog(tables: dict[str, DataFrame], limit: int = 50, offset: int = 0, sort_by: str = "largest_pore_volume", sort_dir: str = "desc", **filters) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one row with the total). Bounds on one page keep the sort a
    top-k; the total is an aggregate over the same plan."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    order = sort_key(sort_by, sort_dir)
    rows = filtered(catalog_join(tables["structures"], tables["structure_aggregates"], tables["renders"]), tables.get("structure_pdb_aliases"), **filters)
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))


def metric_columns(df: DataFrame, preset: str) -> DataFrame:
    return df.select("structure_id", "source_label", *METRIC_PRESETS[preset])


def list_runs(runs: DataFrame, structures: DataFrame) -> DataFrame:
    """Runs with their number of structures, also of none; newest first."""
    counts = structures.groupBy("run_id").agg(F.count("structure_id").alias("n"))
    return runs.join(counts, "run_id", "left").withColumn("num_structures", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.desc("created_at"), "run_id")


def hit_detail(tables: dict[str, DataFrame], structure_id=None) -> DataFrame:
    """Structures with aggregates, render, aliases and volumes (no hubs; by kind, rank)."""
    of = (lambda df: df.filter(F.col("structure_id") == structure_id)) if structure_id is not None else (lambda df: df)
    v = of(tables["volumes"]).filter("kind <> 'hub'").groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("kind", "rank_in_kind", *METRICS))).alias("volumes"))
    a = of(tables["structure_pdb_aliases"]).groupBy("structure_id").agg(F.sort_array(F.collect_set("alias_pdb_id")).alias("aliases"))
    base = of(tables["structures"]).join(of(tables["structure_aggregates"]), "structure_id", "left").join(of(tables["renders"]), "structure_id", "left")
    return base.join(v, "structure_id", "left").join(a, "structure_id", "left")


def viewer_record(detail: DataFrame, root: str) -> DataFrame:
    """``detail`` with format and links; a link is null where its file is."""
    link = lambda c, kind: F.when(F.col(c).isNotNull() & (F.length(c) > 0), F.concat(F.lit(f"{root}/{kind}/"), F.col("structure_id").cast("string")))
    return detail.withColumns({
        "format": text.structure_format(F.coalesce("annotated_cif_path", "input_path")),
        "urls": F.struct(link("annotated_cif_path", "structure").alias("structure"), link("annotation_json_path", "annotation").alias("annotation"), *[link(f"{a}_png_path", f"render/{a}").alias(a) for a in "xyz"]),
    })


def select_volume_atoms(atoms: DataFrame, code: str, variant: str = "all") -> DataFrame:
    """Pseudo-atoms of one volume code: all, those of mouths, or those of the core."""
    mine = atoms.filter(F.col("res_name") == code)
    return {"all": mine, "mouth": mine.filter("b_factor > 0"), "core": mine.filter("b_factor <= 0")}[variant]


def has_artifact(df: DataFrame, column: str = "annotated_cif_path") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.length(column) > 0))


# building


def summary_entries(sections: DataFrame) -> DataFrame:
    """Entries to index: results, then skips that were resumed, first of each source.
    ``sections``: section, ord, source, reason, ..."""
    source = F.coalesce("source", F.lit("structure"))
    kept = sections.filter((F.col("section") == "results") | ((F.col("section") == "skipped") & (F.col("reason") == "resume_existing_outputs")))
    w = W.partitionBy("source").orderBy(F.when(F.col("section") == "results", 0).otherwise(1), "ord")
    return kept.withColumn("source", source).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def aliases_of(structures: DataFrame) -> DataFrame:
    """The own id first, then valid cluster members, each alias once a structure.
    ``structures``: structure_id, pdb_id, cluster_member_pdb_ids."""
    own = structures.select("structure_id", F.lit(0).alias("prio"), text.normalize_id(F.col("pdb_id")).alias("alias_pdb_id"), F.lit("canonical").alias("alias_source"))
    members = structures.select("structure_id", F.posexplode(text.member_ids(F.col("cluster_member_pdb_ids"))).alias("p", "alias_pdb_id"))
    both = own.unionByName(members.select("structure_id", (F.col("p") + 1).alias("prio"), "alias_pdb_id", F.lit("cluster_member").alias("alias_source"))).filter("alias_pdb_id is not null")
    best = both.groupBy("structure_id", "alias_pdb_id").agg(F.min_by("alias_source", "prio").alias("alias_source"))
    return best


def structure_key(run_id: Column, source: Column) -> Column:
    """A key that depends on run and source alone."""
    return F.xxhash64(run_id, source)


def build_catalog(sections: DataFrame, annotations: DataFrame, metrics: DataFrame | None, run_id: str, created_at: str, strict: bool = False) -> dict[str, DataFrame]:
    """The six tables of one run. ``annotations``: source, ord, volume columns and
    fractions, one row a volume; entries without annotation are left out, or an error
    if ``strict``. ``metrics``: source and structure metrics."""
    entries = summary_entries(sections)
    known = annotations.groupBy("source").agg(*[F.max(f"frac_{f}").alias(f"frac_{f}") for f in ("alpha", "beta", "coil")])
    if strict:
        known = known.withColumn("_known", F.lit(True))
        entries = entries.join(known, "source", "left").withColumn("source", F.when(F.col("_known"), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("no annotation for "), F.col("source"))))).drop("_known")
    else:
        entries = entries.join(known, "source")
    if metrics is not None:
        entries = entries.join(metrics, "source", "left")
    else:
        entries = entries.withColumns({c: F.lit(None).cast("long") for c in _BASE})
    stem = F.regexp_extract(F.coalesce("input_path", F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    structures = entries.select(
        structure_key(F.lit(run_id), F.col("source")).alias("structure_id"), F.lit(run_id).alias("run_id"), F.col("source").alias("source_label"), text.infer_id(F.col("pdb_id"), F.col("source"), stem).alias("pdb_id"),
        "input_path", F.col("structure_output").alias("annotated_cif_path"), F.col("annotation_output").alias("annotation_json_path"), *_BASE, "frac_alpha", "frac_beta", "frac_coil", "cluster_member_pdb_ids",
    )
    named = annotations.withColumn("structure_id", structure_key(F.lit(run_id), F.col("source"))).join(structures.select("structure_id"), "structure_id", "left_semi")
    volumes = rank_in_kind(indexable(named))
    return {
        "runs": sections.sparkSession.createDataFrame([(run_id, created_at)], "run_id string, created_at string"), "structures": structures.drop("cluster_member_pdb_ids"),
        "structure_pdb_aliases": aliases_of(structures), "volumes": volumes.drop("ord"), "structure_aggregates": kind_aggregates(structures, volumes),
        "renders": structures.select("structure_id", *[F.lit(None).cast("string").alias(c) for c in ("x_png_path", "y_png_path", "z_png_path", "render_style_hash")], F.lit("pending").alias("render_status")),
    }


def index_counters(tables: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    sources = {"indexed_structures": tables["structures"], "indexed_volumes": tables["volumes"], "n": entries}
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sources.items()]
    total = lambda name: F.sum(F.when(F.col("name") == name, F.col("rows")))
    counts = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return counts.agg(total("indexed_structures").alias("indexed_structures"), total("indexed_volumes").alias("indexed_volumes"), (total("n") - total("indexed_structures")).alias("skipped"))


# render work


def should_render(status: Column, style_mismatch: Column, outputs_exist: Column, include_failed: bool = False, force: bool = False) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit("pending"))))
    return F.lit(force) | F.when(s == "pending", True).when(s == "failed", include_failed).when(s == "done", ~outputs_exist | style_mismatch).otherwise(True)


def plan_renders(structures: DataFrame, renders: DataFrame, style: str, run_id: str | None = None, include_failed: bool = False, force: bool = False, reuse_only: bool = False, limit: int | None = None) -> DataFrame:
    """Work rows with ``action`` (render, reuse or skip). ``renders`` has
    ``outputs_exist``. ``limit`` counts what is rendered or reused, by structure id."""
    rows = has_artifact(structures if run_id is None else structures.filter(F.col("run_id") == run_id)).join(renders, "structure_id")
    differs = F.coalesce("render_style_hash", F.lit("")) != style
    if reuse_only:
        action = F.when(F.col("outputs_exist"), "reuse").otherwise("skip")
    else:
        action = F.when(should_render(F.col("render_status"), differs, F.col("outputs_exist"), include_failed, force), "render").otherwise("skip")
    rows = rows.select("structure_id", "run_id", "source_label", "render_status", action.alias("action"))
    if limit is None:
        return rows
    chosen = rows.filter("action <> 'skip'").orderBy("structure_id").limit(limit)
    return chosen.unionByName(rows.filter("action = 'skip'"))


def update_renders(renders: DataFrame, changes: DataFrame) -> DataFrame:
    """``renders`` after keyed changes (structure_id and any of the columns): done,
    failed, adopted or reset rows all go this way. Null in a change keeps the value."""
    named = changes.select("structure_id", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "structure_id"])
    joined = renders.join(named, "structure_id", "left")
    return joined.select("structure_id", *[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in renders.columns if c != "structure_id"])


def reset_renders(renders: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen structures' renders are pending again, without paths or hash."""
    mark = chosen.select("structure_id").distinct().withColumn("_reset", F.lit(True))
    joined = renders.join(mark, "structure_id", "left")
    new = {c: F.when(F.col("_reset"), F.lit("pending") if c == "render_status" else F.lit(None)).otherwise(F.col(c)) for c in renders.columns if c in ("x_png_path", "y_png_path", "z_png_path", "render_style_hash", "render_status")}
    return joined.withColumns(new).select(*renders.columns)


def selector_match(structures: DataFrame, aliases: DataFrame, selectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(structures matched by label, id or alias with the selectors, selectors without
    a match). Callers raise if the second has rows."""
    spark = structures.sparkSession
    wanted = spark.createDataFrame([(s.strip().lower(), s) for s in dict.fromkeys(selectors)], "term string, selector string").dropDuplicates(["term"])
    own = has_artifact(structures).select("structure_id", F.explode(F.array_compact(F.array(F.lower("source_label"), F.lower("pdb_id")))).alias("term"))
    other = aliases.join(has_artifact(structures).select("structure_id"), "structure_id", "left_semi").select("structure_id", F.lower("alias_pdb_id").alias("term"))
    hits = own.unionByName(other).distinct().join(F.broadcast(wanted), "term")  # the caller's own list
    return hits.groupBy("structure_id").agg(F.sort_array(F.collect_set("term")).alias("matched")), wanted.join(hits.select("term").distinct(), "term", "left_anti").select("selector")


def rerender_targets(structures: DataFrame, aliases: DataFrame, renders: DataFrame, selectors: list[str]) -> DataFrame:
    """``renders`` with the selected structures reset; unmatched selectors are errors."""
    hits, missing = selector_match(structures, aliases, selectors)
    if unmatched := [r.selector for r in missing.collect()]:
        raise ValueError(f"no structure matches {', '.join(sorted(unmatched))}")
    return reset_renders(renders, hits)
