"""Event logs and annotation files as streams.

What a stream has kept lies in a folder of deltas, one a micro-batch, each with the rows
that the batch changed. A batch that runs again replaces its own delta. ``folded`` puts
all deltas so far into one base, so a long run doesn't gather folders without end.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.text import eta_text
from ..operators.steps import settled


def event_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


# deltas


def _numbers(spark: SparkSession, folder: str, name: str) -> set[int]:
    """Numbers of the whole ``name=<number>`` folders in ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return set()
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().partition("=")[2]) for p in done}


def _to_deltas(stream: DataFrame, folder: str, checkpoint: str):
    """Writes the rows that each micro-batch changes; the state is in the state store."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/delta/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def _deltas(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Rows of the newest base and of all deltas after it, and the newest number. A delta
    that is missing between others is an error: the state can't be told without it."""
    base = max(_numbers(spark, f"{folder}/base", "upto"), default=-1)
    after = sorted(n for n in _numbers(spark, f"{folder}/delta", "batch") if n > base)
    newest = after[-1] if after else base
    missing = set(range(base + 1, newest + 1)) - set(after)
    if missing or newest < 0:
        raise FileNotFoundError(f"no delta of batch {min(missing, default=0)} in {folder}")
    paths = [f"{folder}/delta/batch={n}" for n in after] + ([f"{folder}/base/upto={base}"] if base >= 0 else [])
    return spark.read.parquet(*paths), newest


def folded(spark: SparkSession, folder: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """Writes what ``read`` gives as a new base and removes what it replaces. The base
    counts only when it is whole, so a fold that fails leaves the old files in use."""
    _, newest = _deltas(spark, folder)
    read(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/upto={newest}")
    for part, name, last in (("delta", "batch", newest), ("base", "upto", newest - 1)):
        for n in _numbers(spark, f"{folder}/{part}", name):
            if n <= last:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/{name}={n}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


# run state


def _last() -> Column:
    """Ends beat plans, then the greatest number, then the name of the section."""
    return F.max(F.struct((F.col("section") != "planned").alias("ended"), "seq", "section")).alias("last")


def stream_run_state(events: DataFrame, state: str, checkpoint: str):
    """Keeps the latest section of each source (source, section, seq) in ``state``. The
    state store merges a micro-batch with the entries of its own sources, and only
    these are written, so the cost of a batch follows the batch and not the state."""
    return _to_deltas(events.groupBy("source").agg(_last()).select("source", "last.section", "last.seq"), state, checkpoint)


def run_state(spark: SparkSession, state: str) -> DataFrame:
    """The latest section of each source over the base and the deltas."""
    rows, _ = _deltas(spark, state)
    return rows.groupBy("source").agg(_last()).select("source", "last.section", "last.seq")


# progress


def stream_progress(events: DataFrame, interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by interval and kind. Late ones count until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), "event").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event", "events")


def interval_rates(events: DataFrame, done: list[str], failed: list[str], interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, events, completed, failed, rate (completed a second) and failed_share (null
    where nothing completed) of each interval, of a stream or a table with ts and event.
    Failed ones are completed too. Without a time an event is in no interval. A stream
    leaves an event out if its interval had ended ``late`` before the newest event of the
    batch before the last."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event").isin(done + failed)).alias("completed"), F.count_if(F.col("event").isin(failed)).alias("failed")
    )
    seconds = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    return counts.select(F.col("w.start").alias("start"), "events", "completed", "failed", (F.col("completed") / seconds).alias("rate"), F.try_divide("failed", "completed").alias("failed_share"))


def stream_rates(events: DataFrame, folder: str, checkpoint: str, done: list[str], failed: list[str], interval: str = "1 hour", late: str = "1 hour"):
    """Keeps the rates of each interval in ``folder``; a batch writes the intervals that
    it changes. ``ProgressListener`` sees the events on their way."""
    return _to_deltas(interval_rates(observed(events, done, failed), done, failed, interval, late), folder, checkpoint)


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each interval; an interval only ever gains events."""
    rows, _ = _deltas(spark, folder)
    fields = [c for c in rows.columns if c not in ("start", "events")]
    return rows.groupBy("start").agg(F.max(F.struct("events", *fields)).alias("r")).select("start", "r.*")


OBSERVED = "progress"


def observed(events: DataFrame, done: list[str], failed: list[str]) -> DataFrame:
    """``events`` with counts and times that ``ProgressListener`` reads, each batch."""
    at = F.col("ts").cast("timestamp").cast("double")
    return events.observe(
        OBSERVED, F.count("ts").alias("rows"), F.count_if(F.col("event").isin(done + failed)).alias("completed"), F.count_if(F.col("event").isin(failed)).alias("failed"),
        F.min(at).alias("first"), F.max(at).alias("last"),
    )


class ProgressListener(StreamingQueryListener):
    """Totals of streams that ``observed`` marks, as they run: rows, completed, failed,
    rate and time left of ``total``. A batch told twice counts once."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.completed, self.failed = total, 0, 0, 0
        self._first = self._last = None
        self._seen: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(OBSERVED)
        query, batch = str(event.progress.id), event.progress.batchId
        with self._lock:
            if found is None or found["first"] is None or batch <= self._seen.get(query, -1):
                return
            self._seen[query] = batch
            self.rows += found["rows"]
            self.completed += found["completed"]
            self.failed += found["failed"]
            self._first = found["first"] if self._first is None else min(self._first, found["first"])
            self._last = found["last"] if self._last is None else max(self._last, found["last"])

    @property
    def rate(self) -> float:
        """Completed events a second of event time; 0 where no time has passed."""
        with self._lock:
            passed = 0.0 if self._first is None else self._last - self._first
            return self.completed / passed if passed > 0 else 0.0

    @property
    def seconds_left(self) -> float | None:
        """Null where the total or the rate isn't known."""
        rate = self.rate
        return max(0, self.total - self.completed) / rate if self.total is not None and rate > 0 else None

    def late(self, kept: DataFrame) -> int:
        """Rows that came after the watermark had passed their interval: all that were
        observed, less those that the intervals ``kept`` hold."""
        return self.rows - (kept.agg(F.sum("events")).first()[0] or 0)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row: completed, failed, percent, rate, eta."""
        left, share = self.seconds_left, 100.0
        if self.total:
            share = round(self.completed * 100.0 / self.total, 1)
        row = spark.createDataFrame([(self.completed, self.failed, share, self.rate, left)], "completed long, failed long, percent double, rate double, left double")
        return row.withColumn("eta", eta_text(F.col("left"))).drop("left")


# index


def stream_index(files: DataFrame, index: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], keys: list[str], buckets: int = 64):
    """Indexes files as they land, each (run, source) once: rows of keys that the index
    has are left out, and a batch that runs again replaces its own rows. The index is in
    folders by ``bucket``, a hash of the keys, and ``batch``: a micro-batch reads the key
    columns of its own keys' buckets alone. ``buckets`` must stay as it was."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash(*keys), F.lit(buckets))
        new = settled(build(batch).withColumn("bucket", bucket))
        path = spark._jvm.org.apache.hadoop.fs.Path(index)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and len(fs.listStatus(path)) > 1:
            asked = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
            old = spark.read.parquet(index).filter(F.col("bucket").isin(asked) & (F.col("batch") != number)).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(old, same, "left_anti")
        rows = new.withColumn("batch", F.lit(number)).repartition(buckets, "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(index)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
