"""Corruption scans, benchmark reports and comparisons of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import control_byte
from .runs import drop_sources


def scan_corruption(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without their bytes, with ``reason`` (null for sound ones)."""
    return files.withColumn("reason", control_byte(F.col(content))).drop(content)


def clean_checkpoint(sections: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoint sections without the sources whose files are corrupt."""
    return drop_sources(sections, scanned.filter("reason is not null"))


def bench_summary(runs: DataFrame, key: str = "case_name") -> DataFrame:
    """Mean, least and greatest seconds, peak memory and the last run's result by
    case. ``runs``: case, seq, elapsed_seconds, max_rss_kb, largest_type."""
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("elapsed_seconds"), 6).alias("mean_seconds"), F.round(F.min("elapsed_seconds"), 6).alias("min_seconds"), F.round(F.max("elapsed_seconds"), 6).alias("max_seconds"),
        F.round(F.max("max_rss_kb") / 1024, 3).alias("max_rss_mb"), F.max_by("largest_type", "seq").alias("largest_type"),
    )


def stage_means(runs: DataFrame, key: str = "case_name") -> DataFrame:
    """Mean seconds by case and stage (a run without a stage counts 0), share of the
    mean total, and what no stage covers as ``untracked``. ``stages`` is a map."""
    whole = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed_seconds").alias("mean_seconds"))
    tracked = F.aggregate(F.map_values("stages"), F.lit(0.0), lambda a, x: a + x)
    full = F.map_concat("stages", F.create_map(F.lit("untracked"), F.greatest(F.lit(0.0), F.col("elapsed_seconds") - tracked)))
    each = runs.select(key, F.explode(full).alias("stage", "seconds")).groupBy(key, "stage").agg(F.sum("seconds").alias("s"))
    out = each.join(whole, key).withColumn("mean", F.round(F.col("s") / F.col("n"), 6))
    return out.select(key, "stage", "mean", F.round(F.col("mean") / F.col("mean_seconds") * 100, 3).alias("percent"))


def stage_top_n(means: DataFrame, n: int, key: str = "case_name") -> DataFrame:
    return means.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("mean"), "stage"))).filter(F.col("rank") <= n)


def perf_compare(reference: DataFrame, new: DataFrame, max_ratio: float = 1.1, key: str = "case_name") -> DataFrame:
    """New over reference mean by case, infinite where the reference is 0."""
    both = reference.select(key, F.col("mean_seconds").alias("reference")).join(new.select(key, F.col("mean_seconds").alias("new")), key)
    ratio = F.when(F.col("reference") > 0, F.col("new") / F.col("reference")).otherwise(F.lit(float("inf")))
    return both.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") <= max_ratio)


def compare_annotations(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """Rows of both sides aligned in order of type, volume and lengths, with what
    differs; equal tables give no mismatch."""
    w = W.partitionBy("structure_id").orderBy("type", F.desc("volume"), F.desc("x"), F.desc("y"), F.desc("z"), "id")

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("structure_id", F.row_number().over(w).alias("row"), *[F.col(c).alias(f"{mark}_{c}") for c in ("type", "volume", "x", "y", "z")])

    both = side(actual, "a").join(side(expected, "e"), ["structure_id", "row"], "full")
    near = [F.abs(F.col(f"a_{c}") - F.col(f"e_{c}")) <= tolerance for c in ("volume", "x", "y", "z")]
    same = F.col("a_type").eqNullSafe(F.col("e_type"))
    for n in near:
        same = same & F.coalesce(n, F.lit(False))
    return both.withColumn("matches", same)
