"""The 1-minute rollup as a stored table that is refreshed where new readings touched it.

Every micro-batch stores its mergeable part and then logs the days it touched. A refresh takes the batches above the
high-water mark of their stream, merges their parts into the stored days they touched and writes those days anew; no
reading is looked at again. The new days come into being by one manifest, which names the live files of every day and
the marks up to which batches are merged. A reader follows the newest manifest and adds the parts above its marks, so
it sees each batch once, before, during and after a refresh, and also after one that broke off.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.tables import delete_paths, save_run

if TYPE_CHECKING:
    from pulsegrid.streaming.jobs import Store

SERIES = ("service", "metric")
SUMS = ("sum_value", "min_value", "max_value", "sample_count")
LAYOUT = ("event_date", *SERIES, "bucket")
ROLLUP_PART = T.StructType(
    [T.StructField("bucket", T.TimestampType())] + [T.StructField(name, T.StringType()) for name in SERIES]
    + [T.StructField(name, T.DoubleType()) for name in ("sum_value", "min_value", "max_value")]
    + [T.StructField("sample_count", T.LongType())]
)
STORED_DAY = T.StructType([*ROLLUP_PART.fields, T.StructField("event_date", T.DateType()), T.StructField("attempt", T.StringType())])
ROLLUP_LOG = T.StructType([T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("day", T.DateType())])
# A row names the live attempt of a day, or the last merged batch of a stream.
ROLLUP_MANIFEST = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("day", T.DateType()), T.StructField("attempt", T.StringType())]
    + [T.StructField("stream", T.StringType()), T.StructField("merged_to", T.LongType())]
)


@dataclass(frozen=True)
class Manifest:
    """State of the stored rollup: one entry per day and one per stream, whatever the number of readings."""

    seq: int = -1
    days: dict[date, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


def rollup_parts(events: DataFrame) -> DataFrame:
    """Mergeable 1-minute aggregates of some readings."""
    minute = F.window(F.col("timestamp").cast("timestamp"), "1 minute")["start"]
    return events.groupBy(minute.alias("bucket"), *SERIES).agg(
        F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def store_part(store: Store, events: DataFrame, stream: str, batch_id: int, run_id: str) -> None:
    """A batch's part of every bucket, then the log rows that make it count. A repeated batch replaces its own."""
    spark = events.sparkSession
    save_run(rollup_parts(events), store.root, "rollup_parts", run_id)
    part = store.runs(spark, "rollup_parts").where(F.col("run_id") == run_id)
    touched = part.select(F.to_date("bucket").alias("day")).distinct()
    logged = touched.select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch_id"), "day")
    save_run(logged.coalesce(1), store.root, "rollup_log", run_id)  # one file: all of the log rows or none


def manifest(spark: SparkSession, store: Store) -> Manifest:
    """The newest state. Each manifest is whole in itself, so of two refreshes side by side one wins and nothing is lost."""
    rows = store.runs(spark, "rollup_manifest")
    last = rows.agg(F.max(F.struct("seq", "run_id")).alias("m")).first()["m"]
    if last is None:
        return Manifest()
    named = rows.where((F.col("run_id") == last["run_id"]) & (F.col("seq") == last["seq"])).collect()
    return Manifest(
        last["seq"],
        {r["day"]: r["attempt"] for r in named if r["day"] is not None},
        {r["stream"]: r["merged_to"] for r in named if r["stream"] is not None},
    )


def pending(spark: SparkSession, store: Store, state: Manifest) -> DataFrame:
    """Log rows of the batches above the marks: run_id, stream, batch_id, day."""
    log = store.runs(spark, "rollup_log").where(F.col("day").isNotNull())
    for stream, mark in state.marks.items():
        log = log.where((F.col("stream") != stream) | (F.col("batch_id") > mark))
    return log


def stored_days(spark: SparkSession, store: Store, state: Manifest, days: Sequence[date]) -> DataFrame:
    """The stored rows of some days; no other day and no replaced file is listed or opened."""
    paths = [f"{store.path('rollup_days')}/attempt={state.days[d]}/event_date={d}" for d in days if d in state.days]
    if not paths:
        return spark.createDataFrame([], STORED_DAY).drop("attempt")
    return spark.read.schema(STORED_DAY).option("basePath", store.path("rollup_days")).parquet(*paths).drop("attempt")


def _parts_of(spark: SparkSession, store: Store, runs: Sequence[str]) -> DataFrame:
    """Parts of some batches, by their partition column."""
    parts = store.runs(spark, "rollup_parts").where(F.col("run_id").isin(list(runs))).drop("run_id")
    return parts.withColumn("event_date", F.to_date("bucket"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*LAYOUT).agg(
        F.sum("sum_value").alias("sum_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.sum("sample_count").alias("sample_count"),
    )


def refresh_rollup(spark: SparkSession, store: Store) -> list[date]:
    """Merge all logged batches above the marks; returns the days written anew.

    Reads the parts of those batches and the stored rows of the days they touched, nothing else. The driver holds one
    row per pending batch and day. A refresh that breaks off has changed nothing.
    """
    state = manifest(spark, store)
    log = pending(spark, store, state).collect()
    if not log:
        return []
    days = sorted({r["day"] for r in log})
    rows = stored_days(spark, store, state, days).unionByName(_parts_of(spark, store, sorted({r["run_id"] for r in log})))
    attempt = uuid.uuid4().hex
    (
        _merged(rows).repartitionByRange(*LAYOUT).sortWithinPartitions(*LAYOUT)
        .write.partitionBy("event_date").parquet(f"{store.path('rollup_days')}/attempt={attempt}")
    )
    live = state.days | dict.fromkeys(days, attempt)
    marks = dict(state.marks)
    for r in log:
        marks[r["stream"]] = max(marks.get(r["stream"], -1), r["batch_id"])
    seq = state.seq + 1
    named = [(seq, d, a, None, None) for d, a in live.items()] + [(seq, None, None, s, m) for s, m in marks.items()]
    save_run(spark.createDataFrame(named, ROLLUP_MANIFEST).coalesce(1), store.root, "rollup_manifest", f"{seq:012d}-{attempt}")
    return days


def read_rollup(
    spark: SparkSession, store: Store, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """bucket, series, avg, min, max, sample_count and event_date as of now, in days from ``start`` to ``end``, both included.

    Where all batches are merged the days are read as stored, one set of files each and without a shuffle; else the
    parts above the marks are added.
    """
    state = manifest(spark, store)

    def wanted(day: date) -> bool:
        return (start is None or day >= start.date()) and (end is None or day <= end.date())

    rows = stored_days(spark, store, state, [d for d in sorted(state.days) if wanted(d)])
    waiting = sorted({r["run_id"] for r in pending(spark, store, state).select("run_id", "day").collect() if wanted(r["day"])})
    if waiting:
        parts = _parts_of(spark, store, waiting)
        for bound, keep in ((start, Column.__ge__), (end, Column.__le__)):
            parts = parts if bound is None else parts.where(keep(F.col("event_date"), F.lit(bound.date())))
        rows = _merged(rows.unionByName(parts))
    return rows.select(
        "bucket", *SERIES, (F.col("sum_value") / F.col("sample_count")).alias("avg_value"),
        "min_value", "max_value", "sample_count", "event_date",
    )


def expire_rollup(spark: SparkSession, store: Store, keep: int = 2) -> int:
    """Delete what none of the newest ``keep`` manifests needs: older manifests, replaced files, merged parts and their log.

    Returns the number of folders deleted. Readers that began before ``keep`` refreshes ago lose their files, so this
    belongs to a quiet schedule. Attempts of refreshes that broke off go too; none may be running.
    """
    rows = store.runs(spark, "rollup_manifest").where(F.col("seq").isNotNull())
    kept = [r["run_id"] for r in rows.select("seq", "run_id").distinct().orderBy(F.desc("seq"), F.desc("run_id")).limit(keep).collect()]
    if not kept:
        return 0
    named = rows.where(F.col("run_id").isin(kept)).collect()
    live = {r["attempt"] for r in named if r["attempt"] is not None}
    # A batch goes once all kept manifests have it merged.
    marks = {}
    for run in kept:
        of_run = {r["stream"]: r["merged_to"] for r in named if r["run_id"] == run and r["stream"] is not None}
        marks = of_run if not marks else {s: min(m, of_run[s]) for s, m in marks.items() if s in of_run}
    log = store.runs(spark, "rollup_log").select("run_id", "stream", "batch_id").distinct().collect()
    merged = {r["run_id"] for r in log if r["batch_id"] <= marks.get(r["stream"], -1)}

    def folders(table: str, column: str, gone) -> list[str]:
        return [f"{store.path(table)}/{column}={value}" for value in sorted(gone)]

    attempts = {r["attempt"] for r in rows.where(F.col("attempt").isNotNull()).select("attempt").distinct().collect()}
    manifests = {r["run_id"] for r in rows.select("run_id").distinct().collect()}
    return delete_paths(spark, [
        *folders("rollup_manifest", "run_id", manifests - set(kept)),
        *folders("rollup_days", "attempt", attempts - live),
        *folders("rollup_log", "run_id", merged),
        *folders("rollup_parts", "run_id", merged),
    ])
