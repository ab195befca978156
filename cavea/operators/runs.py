"""Bookkeeping of batch runs: state, resume, replay, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text

SECTIONS = ["results", "errors", "skipped", "planned"]
#: What a run summary may be replayed by.
ONLY = {"failed": ["errors"], "skipped": ["skipped"], "planned": ["planned"], "all": ["errors", "skipped", "planned", "results"]}


def latest_state(entries: DataFrame) -> DataFrame:
    """The last terminal section of each source, or its plan if it has none.
    ``entries``: source, section, seq."""
    terminal = F.when(F.col("section") == "planned", 1).otherwise(0)
    w = W.partitionBy("source").orderBy(terminal, F.desc("seq"))
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def run_counts(entries: DataFrame) -> DataFrame:
    names = {"results": "num_processed", "errors": "num_failed", "skipped": "num_skipped", "planned": "num_planned"}
    return entries.agg(*[F.count_if(F.col("section") == s).alias(n) for s, n in names.items()])


def event_outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("events"))


def progress(events: DataFrame, total: int, done: list[str], failed: list[str]) -> DataFrame:
    """completed, failed, percent, rate and eta over an event log (ts, event)."""
    counts = events.agg(
        F.count_if(F.col("event").isin(done + failed)).alias("completed"), F.count_if(F.col("event").isin(failed)).alias("failed"),
        (F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))).alias("elapsed"),
    )
    rate = F.when(F.col("elapsed") > 0, F.col("completed") / F.col("elapsed")).otherwise(0.0)
    left = F.greatest(F.lit(0), F.lit(total) - F.col("completed"))
    percent = F.when(F.lit(total) > 0, F.col("completed") * 100.0 / total).otherwise(100.0)
    return counts.withColumns({"rate": rate, "percent": F.round(percent, 1)}).withColumn("eta", text.eta_text(F.when(F.col("rate") > 0, left / F.col("rate"))))


# resume

PAYLOAD = ["source", "input_path", "output_structure_cif", "num_volumes", "volumes"]


def resume_status() -> tuple[Column, Column]:
    """(status, reason) of a source's outputs: missing, partial, invalid or valid.

    Rows hold source, structure_output and annotation_output (expected paths), the
    listing as structure_bytes, annotation_bytes (null if absent), structure_is_file,
    annotation_is_file, and the annotation's text in ``payload``.
    """
    sb, ab = F.col("structure_bytes"), F.col("annotation_bytes")
    p = F.col("payload")
    keys = F.json_object_keys(p)
    get = lambda k: F.get_json_object(p, f"$.{k}")
    absent = F.filter(F.array(*[F.lit(k) for k in PAYLOAD]), lambda k: ~F.array_contains(keys, k))
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    n = F.json_array_length(get("volumes"))
    number = F.regexp_extract(p, r'"num_volumes"\s*:\s*(-?[0-9]+)\s*[,}]', 1).try_cast("long")
    text_path = F.coalesce(get("output_structure_cif"), F.lit(""))
    is_string = p.rlike(r'"output_structure_cif"\s*:\s*"')
    invalid = F.coalesce(
        F.when(~F.col("structure_is_file"), F.concat(F.lit("structure output is not a regular file: "), F.col("structure_output"))),
        F.when(sb <= 0, F.concat(F.lit("structure output is empty: "), F.col("structure_output"))),
        F.when(~F.col("annotation_is_file"), F.concat(F.lit("annotation output is not a regular file: "), F.col("annotation_output"))),
        F.when(ab <= 0, F.concat(F.lit("annotation output is empty: "), F.col("annotation_output"))),
        F.when(F.try_parse_json(p).isNull(), F.lit("annotation JSON is invalid")),
        F.when(~F.ltrim(p).startswith("{"), F.lit("annotation JSON root must be an object")),
        F.when(F.size(absent) > 0, F.concat(F.lit("annotation JSON missing required keys: "), F.array_join(absent, ", "))),
        F.when(~get("source").eqNullSafe(F.col("source")), F.concat(F.lit("annotation source mismatch: expected "), F.col("source"), F.lit(", found "), F.coalesce(get("source"), F.lit("null")))),
        F.when(~is_string | (F.trim(text_path) == ""), F.lit("annotation output_structure_cif must be a non-empty string")),
        F.when(text_path != F.col("structure_output"), F.concat(F.lit("annotation output_structure_cif does not match expected path: "), text_path)),
        F.when(n.isNull(), F.lit("annotation volumes must be a list")),
        F.when(number.isNull(), F.lit("annotation num_volumes must be an integer")),
        F.when(number != n, F.concat(F.lit("annotation num_volumes does not match volumes length: "), number.cast("string"), F.lit(" != "), n.cast("string"))),
    )
    status = F.when(sb.isNull() & ab.isNull(), "missing").when(sb.isNull() | ab.isNull(), "partial").when(invalid.isNotNull(), "invalid").otherwise("valid")
    reason = F.when(sb.isNull() & ab.isNull(), F.lit(None)).when(ab.isNull(), name("structure_output")).when(sb.isNull(), name("annotation_output")).otherwise(invalid)
    return status, reason


def terminal_skip_valid(policy: str, max_residues: int | None) -> Column:
    """A stored skip that still holds: same source, paths and policy, and more
    residues than allowed now. The record is in ``record`` (a struct)."""
    if max_residues is None:
        return F.lit(False)
    r = F.col("record")
    holds = (
        (r["kind"] == "terminal_skip") & (r["reason"] == "post_assembly_residue_limit") & (r["source"] == F.col("source")) & (r["assembly_policy"] == policy) & (r["input_path"] == F.col("input_path"))
        & (r["structure_output"] == F.col("structure_output")) & (r["annotation_output"] == F.col("annotation_output")) & (r["actual_residues"] > max_residues)
    )
    return F.coalesce(holds, F.lit(False))


def resume_plan(inputs: DataFrame, outputs: DataFrame, records: DataFrame, policy: str = "biological", max_residues: int | None = None) -> DataFrame:
    """``inputs`` (source, input_path, structure_output, annotation_output) with
    status, reason, action (skip or analyze), reason_kind and overwrite.
    ``outputs``: path, bytes, is_file, payload; ``records``: source, record."""
    side = lambda kind: outputs.select(F.col("path").alias(f"{kind}_output"), F.col("bytes").alias(f"{kind}_bytes"), F.col("is_file").alias(f"{kind}_is_file"), *([F.col("payload")] if kind == "annotation" else []))
    rows = inputs.join(side("structure"), "structure_output", "left").join(side("annotation"), "annotation_output", "left").join(records, "source", "left")
    status, reason = resume_status()
    rows = rows.withColumns({"status": status, "reason": reason}).withColumn("terminal", (F.col("status") == "missing") & terminal_skip_valid(policy, max_residues))
    kind = F.when(F.col("terminal"), "terminal_skip").otherwise(F.col("status"))
    return rows.select(
        "source", "input_path", "structure_output", "annotation_output", "status", "reason", kind.alias("reason_kind"), F.when(kind.isin("valid", "terminal_skip"), "skip").otherwise("analyze").alias("action"),
        (F.col("status") == "invalid").alias("overwrite"),
    )


def pending_structures(plan: DataFrame) -> DataFrame:
    return plan.filter("action = 'analyze'")


def resume_counts(plan: DataFrame, samples: int = 3) -> DataFrame:
    """Counts by kind and up to three labels of each that is reported."""
    kinds = {"valid": "skipped_valid", "terminal_skip": "skipped_terminal", "partial": "reanalyze_partial", "invalid": "reanalyze_invalid"}
    counts = plan.agg(*[F.count_if(F.col("reason_kind") == k).alias(n) for k, n in kinds.items()])
    top = plan.withColumn("_n", F.row_number().over(W.partitionBy("reason_kind").orderBy("source"))).filter(F.col("_n") <= samples)
    shown = top.agg(*[F.sort_array(F.collect_list(F.when(F.col("reason_kind") == k, F.col("source")))).alias(f"{n}_samples") for k, n in kinds.items() if k != "valid"])
    both = counts.unionByName(shown, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def plan_dry_run(plan: DataFrame) -> DataFrame:
    return pending_structures(plan).select(F.lit("planned").alias("section"), "source", "input_path", "structure_output", "annotation_output")


# replay and summaries


def replay(entries: DataFrame, only: str = "failed") -> DataFrame:
    """(source, input_path) of the chosen sections, the first of each pair; entries
    without a path cannot be replayed. ``entries``: section, ord, source, input_path."""
    if only not in ONLY:
        raise ValueError(f"only must be one of {sorted(ONLY)}")
    rank = F.array_position(F.array(*[F.lit(s) for s in ONLY["all"]]), F.col("section"))
    kept = entries.filter(F.col("section").isin(ONLY[only]) & F.col("input_path").isNotNull())
    w = W.partitionBy("source", "input_path").orderBy(rank, "ord")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def failures(entries: DataFrame) -> DataFrame:
    """Failed inputs once each, for a failures manifest."""
    return replay(entries, "failed")


def enrich_entries(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Entries with metadata of their source where they lack it."""
    extra = [c for c in meta.columns if c != "source"]
    joined = entries.join(meta.select("source", *[F.col(c).alias(f"_{c}") for c in extra]), "source", "left")
    return joined.select(*[c for c in entries.columns if c not in extra], *[F.coalesce(c, f"_{c}").alias(c) if c in entries.columns else F.col(f"_{c}").alias(c) for c in extra])


def summarize_run(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final entries, counts with ``ok``, failures)."""
    last = latest_state(entries)
    return last, run_counts(last).withColumn("ok", F.col("num_failed") == 0), failures(last.withColumn("ord", F.col("seq")))


def drop_sources(sections: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkpoint sections without bad sources, removed rows by section)."""
    gone = sections.join(bad.select("source").distinct(), "source", "left_semi").groupBy("section").agg(F.count(F.lit(1)).alias("removed"))
    return sections.join(bad.select("source").distinct(), "source", "left_anti"), gone


def resolve_paths(raw: DataFrame, listing: DataFrame) -> DataFrame:
    """``raw`` (key, candidates) with ``path``: the first that is listed, else the first."""
    each = raw.select("key", F.posexplode("candidates").alias("ord", "path"))
    found = listing.select("path").distinct().withColumn("_there", F.lit(True))
    best = each.join(found, "path", "left").groupBy("key").agg(F.min(F.struct(F.col("_there").isNull().alias("no"), "ord", "path")).alias("b"))
    return raw.join(best.select("key", F.col("b.path").alias("path")), "key", "left")
