"""Breaking lineage in long or iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors that ``spark.checkpoint.dir`` names;
    only a session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cavea.steps.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cavea-")
        spark.conf.set("cavea.steps.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: the plan starts anew there, lost executors
    cost nothing before it, and its true size guides later joins."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def written(df: DataFrame) -> str:
    """The new folder in which ``df`` is written."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def running(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows up to each in order. Rows
    are dealt by ranges of the order; sums of ranges give each its start, so no task
    holds all rows. Rows equal in ``order`` come in any order."""
    columns = df.columns
    placed = settled(df.repartitionByRange(*order).withColumns({"_value": value, "_part": F.spark_partition_id()}))
    per = placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = per.select("_part", (F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row a range
    within = F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").select(*columns, (F.col("_within") + F.col("_before")).alias(out))
