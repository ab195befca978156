"""Choosing representatives from cluster lists and entry metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text
from .steps import running


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def tokens(lines: DataFrame) -> DataFrame:
    """(line, pos, entry, valid) of cluster lines (line, value)."""
    split = lines.select("line", F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("pos", "token"))
    entry = text.entity_to_entry(F.col("token"))
    return split.select("line", "pos", entry.alias("entry"), text.is_entry_id(entry).alias("valid"))


def parse_members(lines: DataFrame) -> DataFrame:
    """(rep_id, rep_ord, member_id, member_ord): a line's first valid entry stands for
    its valid entries; lines of one representative merge in order."""
    good = tokens(lines).filter("valid")
    rep = F.first("entry").over(W.partitionBy("line").orderBy("pos"))
    rows = first_seen(good.withColumn("rep_id", rep).withColumnRenamed("entry", "member_id"), ["rep_id", "member_id"], ["line", "pos"])
    at = rows.groupBy("rep_id").agg(F.min(F.struct("line", "pos")).alias("at"))
    heads = numbered(at, "at")
    w = W.partitionBy("rep_id").orderBy("line", "pos")
    return rows.withColumn("member_ord", F.row_number().over(w) - 1).join(heads.select("rep_id", "rep_ord"), "rep_id").select("rep_id", "rep_ord", "member_id", "member_ord")


def numbered(reps: DataFrame, order: str) -> DataFrame:
    """``reps`` with ``rep_ord``, their index from 0 in file order."""
    return running(reps, [order], F.lit(1), "_nth").withColumn("rep_ord", (F.col("_nth") - 1).cast("int")).drop("_nth")


def parse_reps(lines: DataFrame, include_non_entries: bool = False) -> DataFrame:
    """(rep_id, rep_ord): the first token of each line, whether valid or not; invalid
    ones are dropped unless asked for."""
    heads = tokens(lines).filter("pos = 0")
    heads = heads if include_non_entries else heads.filter("valid")
    seen = heads.groupBy(F.col("entry").alias("rep_id")).agg(F.min("line").alias("line"))
    return numbered(seen, "line").drop("line")


def cap_representatives(reps: DataFrame, most: int | None) -> DataFrame:
    return reps if most is None else reps.filter(F.col("rep_ord") < most)


def shard_filter(reps: DataFrame, n: int, k: int) -> DataFrame:
    """Every n-th representative from the k-th."""
    if n < 1 or not 0 <= k < n:
        raise ValueError("shards need n >= 1 and 0 <= k < n")
    return reps.filter(F.col("rep_ord") % n == k)


def filter_reason(methods: Column, resolution: Column, residues: Column, allowed: list[str] | None, max_resolution: float | None = None, max_residues: int | None = None) -> Column:
    """Why an entry fails, null if it passes: experimental_method, missing_resolution,
    resolution, residue_count, the first that holds. A null residue count passes."""
    reasons = []
    if allowed is not None:
        labels = F.array(*[F.lit(m) for m in allowed])
        reasons.append(F.when(~F.coalesce(F.arrays_overlap(methods, labels), F.lit(False)), "experimental_method"))
    if max_resolution is not None:
        reasons += [F.when(resolution.isNull(), "missing_resolution"), F.when(resolution > max_resolution, "resolution")]
    if max_residues is not None:
        reasons.append(F.when(residues > max_residues, "residue_count"))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def entry_filter(meta: DataFrame, names: list[str] | None = None, max_resolution: float | None = None, max_residues: int | None = None, any_method: bool = False) -> DataFrame:
    """``meta`` (exptl, rcsb_entry_info) with ``reason``."""
    info = "rcsb_entry_info"
    reason = filter_reason(
        text.methods(F.col("exptl")), text.best_resolution(F.col(f"{info}.resolution_combined")), F.col(f"{info}.deposited_polymer_monomer_count").try_cast("int"),
        None if any_method else text.expand_methods(names), max_resolution, max_residues,
    )
    return meta.withColumn("reason", reason)


def metadata_split(reps: DataFrame, store: DataFrame) -> DataFrame:
    """``reps`` with their record and ``lookup``: hit, negative or miss."""
    state = F.when(F.col("kind") == "entry", "hit").when(F.col("kind") == "negative", "negative").otherwise("miss")
    return reps.join(store.withColumnRenamed("pdb_id", "rep_id"), "rep_id", "left").withColumn("lookup", state)


def take_until_target(decided: DataFrame, target: int | None, order: str = "rep_ord", passed: str = "passed") -> DataFrame:
    """The rows looked at until ``target`` have passed."""
    if target is None:
        return decided
    return running(decided, [order], F.col(passed).cast("int"), "_s").filter(F.col("_s") - F.col(passed).cast("int") < target).drop("_s")


def attach_members(selected: DataFrame, members: DataFrame) -> DataFrame:
    listed = members.groupBy("rep_id").agg(F.sort_array(F.collect_list(F.struct("member_ord", "member_id"))).alias("m"))
    return selected.join(listed, "rep_id", "left").withColumn("cluster_member_pdb_ids", F.transform("m", lambda x: x["member_id"])).drop("m")


def select_representatives(lines: DataFrame, store: DataFrame, names: list[str] | None = None, max_resolution: float | None = None, max_residues: int | None = None, target: int | None = None, shard: tuple[int, int] | None = None, cap: int | None = None, any_method: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, rejected with reason, counters). Only rows looked at before the
    target is met are rejected. ``store``: pdb_id, kind, exptl, rcsb_entry_info."""
    members = parse_members(lines)
    reps = cap_representatives(members.select("rep_id", "rep_ord").distinct(), cap)
    reps = shard_filter(reps, *shard) if shard else reps
    found = entry_filter(metadata_split(reps, store), names, max_resolution, max_residues, any_method)
    reason = F.when(F.col("lookup") == "negative", "metadata_negative").when(F.col("lookup") == "miss", "metadata_missing").otherwise(F.col("reason"))
    seen = take_until_target(found.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull()), target)
    selected = attach_members(seen.filter("passed").select("rep_id", "rep_ord"), members)
    rejected = seen.filter("not passed").select("rep_id", "rep_ord", "reason")
    return selected, rejected, selection_counters(seen)


def selection_counters(seen: DataFrame) -> DataFrame:
    why = ["experimental_method", "missing_resolution", "resolution", "residue_count", "metadata_negative", "metadata_missing"]
    return seen.agg(F.count(F.lit(1)).alias("examined"), F.count_if("passed").alias("selected"), *[F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in why], *[F.count_if(F.col("lookup") == s).alias(f"metadata_{s}") for s in ("hit", "negative", "miss")])


def download_plan(selected: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """What has to be fetched: ids without a file (``files``: pdb_id, path), or all."""
    return selected if overwrite else selected.join(files.select(F.col("pdb_id").alias("rep_id")), "rep_id", "left_anti")


def upsert_metadata(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new records in place of old ones of the same id."""
    return store.join(new.select("pdb_id"), "pdb_id", "left_anti").unionByName(new, allowMissingColumns=True)


def clear_negative(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store without negative records, one row with how many there were)."""
    return store.filter("kind <> 'negative'"), store.agg(F.count_if(F.col("kind") == "negative").alias("removed"))


def store_inspect(store: DataFrame) -> DataFrame:
    return store.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))
