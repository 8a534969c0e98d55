"""Structured Streaming forms of ingest, rollup, scoring, sessions and the alert cycle."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid import schemas
from pulsegrid.functions import fixed_values as V
from pulsegrid.operators.incidents import alert_cycle, join_slots, slot_counts
from pulsegrid.operators.ingest import insert_anomalies, insert_if_absent, parse_events, recent_target, validate_events
from pulsegrid.operators.registry import current_models
from pulsegrid.operators.scoring import LoadedSurfaces, load_surfaces
from pulsegrid.plans.detection import detect
from pulsegrid.session import broadcast_if_small, pin_small
from pulsegrid.sources.key_index import KeyIndex, insert_indexed
from pulsegrid.sources.tables import (
    dated, delete_paths, ensure_table, load_models, load_runs, read_metrics_table, save_run, write_metrics_table,
)
from pulsegrid.streaming.refreshed_rollup import ROLLUP_LOG, ROLLUP_MANIFEST, ROLLUP_PART, read_rollup, store_part

SERIES = ("service", "metric")
EVENT_COLUMNS = ("event_id", *SERIES, "value", "timestamp", "labels")


def read_metric_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Queued events, one JSON text per line, as rows (data, source_file, arrival); arrival sorts as files and lines came."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = F.struct(
        F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("part"),
    )
    return reader.text(folder).select(
        F.col("value").alias("data"), F.col("_metadata.file_path").alias("source_file"), place.alias("arrival")
    )


def read_kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """The same from Kafka, where its connector is on the class path. Order holds within a Kafka partition."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    place = F.struct(
        F.unix_micros("timestamp").alias("at"), F.col("topic").alias("source"),
        F.col("partition").cast("bigint").alias("part"), F.col("offset"),
    )
    return reader.load().select(
        F.col("value").cast("string").alias("data"), F.col("topic").alias("source_file"), place.alias("arrival")
    )


def read_table_stream(spark: SparkSession, folder: str, file_name: str, schema: T.StructType) -> DataFrame:
    """A stored Parquet file as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)


# --- stateless and stateful transformations ------------------------------------------------------


def event_time(events: DataFrame) -> DataFrame:
    """Watermarks need the zoned timestamp type."""
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_rollup_1min(events: DataFrame, horizon: str = V.ROLLUP_REFRESH) -> DataFrame:
    """Final buckets only: append mode emits a bucket once the watermark passed it, and readings later than that are lost.

    ``rollup_batch`` and ``stored_rollup`` give every bucket within a minute.
    """
    return (
        event_time(events).withWatermark("timestamp", horizon)
        .groupBy(F.window("timestamp", "1 minute").alias("w"), *SERIES)
        .agg(
            F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count(F.lit(1)).alias("sample_count"),
        )
        .select(F.col("w.start").alias("bucket"), *SERIES, "avg_value", "min_value", "max_value", "sample_count")
    )


def stream_incidents(
    anomalies: DataFrame, gap_seconds: int = V.GROUPING_SECONDS, horizon: str = V.ROLLUP_REFRESH
) -> DataFrame:
    """Final sessions only, emitted once no reading can extend them; ``slots_batch`` and ``stored_sessions`` give all."""
    return (
        event_time(anomalies).withWatermark("timestamp", horizon)
        .groupBy(F.session_window("timestamp", f"{gap_seconds} seconds").alias("w"), *SERIES)
        .agg(F.count(F.lit(1)).alias("n_anomalies"), F.max("timestamp").alias("last_at"))
        .select(*SERIES, F.col("w.start").alias("started_at"), "last_at", "n_anomalies")
    )


def stream_score(
    events: DataFrame, current: DataFrame, surfaces: DataFrame, threshold: float = V.ANOMALY_THRESHOLD
) -> DataFrame:
    """Stream-static join with the current models; only anomalies come out."""
    return detect(events, current, surfaces, threshold)


# --- running -------------------------------------------------------------------------------------


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there now into a Parquet table."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


@dataclass(frozen=True)
class Store:
    """Folders of the stored tables under one root on shared storage."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def prepare(self, spark: SparkSession) -> None:
        """Make every table readable before the first row arrives."""
        ensure_table(spark, self.path("metrics"), schemas.METRIC_EVENT)
        for table, schema in TABLES.items():
            ensure_table(spark, f"{self.path(table)}/run_id=none", schema)

    def load(self, spark: SparkSession, table: str, without_run: str = "") -> DataFrame:
        """All runs but one: a repeated run must not see what its first attempt stored."""
        return self.runs(spark, table).where(F.col("run_id") != without_run).drop("run_id")

    def runs(self, spark: SparkSession, table: str) -> DataFrame:
        """Rows with the run that stored them; run_id is a partition column, so a filter on it prunes."""
        return load_runs(spark, self.root, table, TABLES[table])

    def metrics(self, spark: SparkSession) -> DataFrame:
        """Rows appended directly and those of published attempts; files that no commit row names do not exist for readers."""
        direct = read_metrics_table(spark, self.path("metrics"))
        commits = self.load(spark, "published")
        gone = commits.where(F.col("replaces").isNotNull()).select(F.col("replaces").alias("attempt"))
        live = commits.select("attempt").distinct().join(gone, "attempt", "left_anti")
        named = [r["attempt"] for r in live.collect()]  # one a batch since the last compaction
        return direct.unionByName(self.attempts(spark, named)) if named else direct

    def attempts(self, spark: SparkSession, named: list[str]) -> DataFrame:
        """Rows of some attempts; the filter is on a partition column, so no other attempt is opened."""
        schema = T.StructType([*dated(schemas.METRIC_EVENT).fields, T.StructField("attempt", T.StringType())])
        rows = spark.read.schema(schema).parquet(self.path("metrics_published"))
        return rows.where(F.col("attempt").isin(named)).drop("attempt")

    def attempt_of(self, spark: SparkSession, run_id: str) -> str | None:
        """The attempt that a run has published."""
        found = self.runs(spark, "published").where(F.col("run_id") == run_id).where(F.col("replaces").isNull()).first()
        return found["attempt"] if found else None


QUARANTINE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("data", "source_file", "reason")]
)
COUNTS = T.StructType(
    [T.StructField("batch_id", T.LongType())]
    + [T.StructField(name, T.LongType()) for name in ("received", "rejected", "inserted", "skipped", "dead_lettered")]
)
FIRED = T.StructType(
    [T.StructField(name, T.StringType()) for name in SERIES] + [T.StructField("last_fired", T.TimestampType())]
)
CYCLES = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("seq", T.LongType())])
CYCLE_MARKS = T.StructType([T.StructField("stream", T.StringType()), T.StructField("taken_to", T.LongType())])
DEAD = T.StructType([*schemas.METRIC_EVENT.fields, T.StructField("error", T.StringType())])
SLOT_PART = T.StructType(
    [T.StructField(name, T.StringType()) for name in SERIES]
    + [T.StructField(name, T.LongType()) for name in ("slot", "first_us", "last_us", "n")]
)
PUBLISHED = T.StructType([T.StructField(name, T.StringType()) for name in ("attempt", "replaces")])
WRITE_ATTEMPTS = 3
FIRST_PAUSE = 0.2  # seconds before the second attempt; each further pause is twice as long
TABLES = {
    "published": PUBLISHED,
    "cycles": CYCLES, "cycle_marks": CYCLE_MARKS, "dead_letters": DEAD, "rollup_parts": ROLLUP_PART, "rollup_log": ROLLUP_LOG, "rollup_manifest": ROLLUP_MANIFEST, "slot_parts": SLOT_PART, "waiting": schemas.ANOMALY, "anomalies": schemas.ANOMALY, "incidents": schemas.INCIDENT, "incident_members": schemas.INCIDENT_MEMBER,
    "fired": FIRED, "quarantine": QUARANTINE, "accounting": COUNTS, "score_surface": schemas.SCORE_SURFACE,
    "model_versions": schemas.MODEL_VERSION, "model_pointers": schemas.POINTER_EVENT,
}


def stream_name(spark: SparkSession) -> str:
    """Id of the running streaming query, which its checkpoint keeps over restarts; a new checkpoint has a new one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def batch_run(stream: str, batch_id: int) -> str:
    """Run id of a micro-batch: only the same batch of the same stream, repeated, has the same."""
    return f"b-{stream}-{batch_id:012d}"


def rollup_batch(store: Store) -> Callable[[DataFrame, int], None]:
    """Micro-batch of new readings: store its part of each bucket. Late readings count like any other."""

    def each(batch: DataFrame, batch_id: int) -> None:
        stream = stream_name(batch.sparkSession)
        store_part(store, batch, stream, batch_id, batch_run(stream, batch_id))

    return each


def stored_rollup(spark: SparkSession, store: Store, as_of: datetime | str | None = None) -> DataFrame:
    """The 1-minute rollup as stored by now; with ``as_of`` the minute that is not yet over is withheld."""
    rows = read_rollup(spark, store).drop("event_date")
    if as_of is not None:
        rows = rows.where(F.col("bucket") + F.expr("INTERVAL 1 MINUTE") <= F.lit(str(as_of)).cast("timestamp"))
    return rows


def slots_batch(store: Store, gap_seconds: int = V.GROUPING_SECONDS) -> Callable[[DataFrame, int], None]:
    """Micro-batch of anomalies: store which time slots they fill."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = slot_counts(event_time(batch), gap_seconds)
        save_run(rows, store.root, "slot_parts", batch_run(stream_name(batch.sparkSession), batch_id))

    return each


def stored_sessions(spark: SparkSession, store: Store, gap_seconds: int = V.GROUPING_SECONDS) -> DataFrame:
    """All sessions as known by now, those that may still grow included."""
    merged = store.load(spark, "slot_parts").groupBy(*SERIES, "slot").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
    )
    sessions = join_slots(merged, gap_seconds).groupBy(*SERIES, "started_us").agg(
        F.max("last_us").alias("last_us"), F.sum("n").alias("n_anomalies")
    )
    return sessions.select(
        *SERIES, F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("last_us").alias("last_at"), "n_anomalies"
    )


def _in_arrival_order(batch: DataFrame) -> DataFrame:
    """``arrival`` completed by the row's place in the batch, which keeps the order of lines within a file."""
    known = [F.col("arrival")] if "arrival" in batch.columns else []
    return batch.withColumn("arrival", F.struct(*known, F.monotonically_increasing_id().alias("line")))


def _not_stored(store: Store, events: DataFrame, index: KeyIndex | None) -> DataFrame:
    """Events whose key the metrics do not hold; with an index only days that may hold one are opened."""
    stored = store.metrics(events.sparkSession)
    if index is not None:
        return insert_indexed(stored, index, events, ["timestamp", "event_id"], ["arrival"])
    return insert_if_absent(recent_target(stored, events), events, ["timestamp", "event_id"], ["arrival"], small_batch=True)


def dedup_batch(store: Store) -> Callable[[DataFrame, int], None]:
    """Micro-batch of events: append those whose (timestamp, event_id) is not stored, however late they come.

    A repeated batch finds its own rows stored and appends nothing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        events = event_time(_in_arrival_order(batch)).select(*EVENT_COLUMNS, "arrival")
        target = recent_target(store.metrics(batch.sparkSession), events)
        new = insert_if_absent(target, events, ["timestamp", "event_id"], ["arrival"], small_batch=True)
        write_metrics_table(new.select(*EVENT_COLUMNS), store.path("metrics"))

    return each


def _commit(spark: SparkSession, store: Store, run_id: str, attempt: str, replaces: Sequence[str] = ()) -> None:
    """One small file makes an attempt's rows visible, and those of the attempts it replaces invisible, at once."""
    rows = [(attempt, None), *((attempt, old) for old in replaces)]
    save_run(spark.createDataFrame(rows, PUBLISHED).coalesce(1), store.root, "published", run_id)


def _publish(write: Callable[[DataFrame, str], None], rows: DataFrame, store: Store, run_id: str) -> str | None:
    """Append rows once: written under the name of an attempt, then named by a commit row. Error text if all attempts fail.

    What a failed or lost attempt left behind is never read, whole or torn. Between attempts the pause doubles.
    """
    error = None
    for n in range(WRITE_ATTEMPTS):
        attempt = uuid.uuid4().hex
        if n:
            time.sleep(FIRST_PAUSE * 2 ** (n - 1))
        try:
            write(rows, f"{store.path('metrics_published')}/attempt={attempt}")
        except Exception as failure:  # whatever the storage says; the events are kept as dead letters
            error = f"{type(failure).__name__}: {str(failure)[:500]}"
            continue
        _commit(rows.sparkSession, store, run_id, attempt)
        return None
    return error


def compact_metrics(spark: SparkSession, store: Store, run_id: str) -> int:
    """Merge the attempts of all completed batches into one, ordered by day and series; returns how many were merged.

    A batch counts as complete by its accounting row, so one that will be repeated keeps its own attempt. Readers see
    either the old attempts or the new one. A compaction that broke off has published nothing.
    """
    complete = store.runs(spark, "accounting").select("run_id").distinct()
    commits = store.runs(spark, "published")
    gone = commits.where(F.col("replaces").isNotNull()).select(F.col("replaces").alias("attempt"))
    merged = commits.where(F.col("run_id").startswith("m-")).select("attempt").distinct()
    done = commits.join(complete, "run_id", "left_semi").select("attempt").unionByName(merged).distinct().join(gone, "attempt", "left_anti")
    old = [r["attempt"] for r in done.collect()]  # one a batch since the last compaction
    if len(old) > 1:
        attempt = uuid.uuid4().hex
        write_metrics_table(store.attempts(spark, old).drop("event_date"), f"{store.path('metrics_published')}/attempt={attempt}")
        _commit(spark, store, f"m-{run_id}", attempt, old)
    return len(old)


def ingest_batch(
    store: Store, write: Callable[[DataFrame, str], None] = write_metrics_table, index: KeyIndex | None = None
) -> Callable[[DataFrame, int], None]:
    """Micro-batch: quarantine bad messages, append new events, score them, append new anomalies.

    New events are published once (see ``_publish``): a repeated batch takes what it has published as its own, so its
    rollup parts and counts are the same as the first time. A failed scoring fails the batch, so it
    is retried instead of being lost. Events that cannot be written go to the dead letters with the
    error, are counted, and are scored like the others. The registry is read for every batch, so new
    models are used at once; their surfaces are loaded again only when the current models changed.
    Late readings are stored like any other: there is no watermark here. With an ``index`` of the stored keys a batch opens
    only days that may hold one of its keys, and adds its own. The accounting row
    comes last and marks the batch as complete for the alert cycle.
    """

    cache: dict[frozenset[str], LoadedSurfaces] = {}

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_name(spark)
        run_id = batch_run(stream, batch_id)
        parsed = parse_events(_in_arrival_order(batch)).persist()
        valid, rejected = validate_events(parsed)
        events = valid.select(*EVENT_COLUMNS, "arrival")
        published = store.attempt_of(spark, run_id)
        if published:
            fresh = store.attempts(spark, [published]).drop("event_date").persist()
        else:
            fresh = _not_stored(store, events, index).drop("arrival").persist()
        events = events.drop("arrival")
        current, rows = pin_small(current_models(store.load(spark, "model_pointers")).select(*SERIES, "model_id"))
        surfaces = load_models(spark, store.root, schemas.SCORE_SURFACE)
        live = surfaces.join(current.select("model_id"), "model_id", "left_semi")
        ids = frozenset(rows.column("model_id").to_pylist()) if rows is not None else None
        loaded = cache.get(ids) or load_surfaces(live)
        cache.clear()
        if ids is not None and loaded is not None and len(loaded.ids) == len(ids):
            cache[ids] = loaded
        found = detect(events, current, live, loaded=loaded).drop("status").persist()
        try:
            save_run(rejected.select("data", "source_file", "reason"), store.root, "quarantine", run_id)
            inserted = fresh.count()
            # Only days that the batch has readings of can hold its anomalies.
            known = recent_target(store.load(spark, "anomalies", run_id).withColumn("event_date", F.to_date("timestamp")), events)
            new = insert_anomalies(known, found, small_batch=True)
            save_run(new.select(schemas.ANOMALY.names), store.root, "anomalies", run_id)
            save_run(slot_counts(new, V.GROUPING_SECONDS), store.root, "slot_parts", run_id)
            error = None
            if inserted and not published:
                if index is not None:  # before the rows can be seen, so that no filter ever misses one
                    index.add(fresh, run_id)
                error = _publish(write, fresh, store, run_id)
            # The parts follow from what is published, so a repeated batch writes the same.
            store_part(store, fresh.limit(0) if error else fresh, stream, batch_id, run_id)
            if error:
                save_run(fresh.withColumn("error", F.lit(error)).select(DEAD.names), store.root, "dead_letters", run_id)
            _account(parsed, 0 if error else inserted, inserted if error else 0, store, batch_id, run_id)
        finally:
            for df in (found, fresh, parsed):
                df.unpersist()

    return each


def _account(parsed: DataFrame, inserted: int, dead: int, store: Store, batch_id: int, run_id: str) -> None:
    bad = F.count_if(F.col("reason").isNotNull())
    received = F.count(F.lit(1))
    counts = parsed.agg(
        F.lit(batch_id).cast("bigint").alias("batch_id"), received.alias("received"), bad.alias("rejected"),
        F.lit(inserted).cast("bigint").alias("inserted"),
        (received - bad - F.lit(inserted + dead)).cast("bigint").alias("skipped"),
        F.lit(dead).cast("bigint").alias("dead_lettered"),
    )
    save_run(counts, store.root, "accounting", run_id)


def complete_to(spark: SparkSession, store: Store, marks: dict[str, int]) -> dict[str, int]:
    """Per stream the last complete batch above its mark; accounting rows of batches up to the marks are not opened."""
    rows = store.runs(spark, "accounting").where(F.col("run_id").startswith("b-"))
    for stream, mark in marks.items():
        rows = rows.where(~F.col("run_id").between(batch_run(stream, 0), batch_run(stream, mark)))
    stream = F.expr(f"substring(run_id, 3, length(run_id) - {len(batch_run('', 0))})")
    found = rows.groupBy(stream.alias("stream")).agg(F.max("batch_id").alias("upto"))
    return {r["stream"]: r["upto"] for r in found.collect()}  # one row a stream


def taken_anomalies(spark: SparkSession, store: Store, marks: dict[str, int], upto: dict[str, int]) -> DataFrame:
    """Anomalies of the batches above ``marks`` up to ``upto``, as ranges of run ids: no other run is opened."""
    taken = F.lit(False)
    for stream, last in upto.items():
        first = marks.get(stream, -1) + 1
        taken = taken | F.col("run_id").between(batch_run(stream, first), batch_run(stream, last))
    return store.runs(spark, "anomalies").where(taken).drop("run_id")


def expire_cycles(spark: SparkSession, store: Store, keep: int = 2) -> int:
    """Delete the state that cycles before the newest ``keep`` left; incidents and members stay. Returns folders deleted.

    The newest cycle may be repeated and then needs its predecessor's state, so at least two are kept.
    """
    if keep < 2:
        raise ValueError("keep at least two cycles")
    runs = [r["run_id"] for r in store.runs(spark, "cycles").where("seq IS NOT NULL").select("seq", "run_id").orderBy(F.desc("seq"), F.desc("run_id")).collect()]
    # The cycles rows go last: an expiry that breaks off finds the rest again.
    state = ("waiting", "fired", "cycle_marks", "cycles")
    return delete_paths(spark, [f"{store.path(table)}/run_id={run}" for table in state for run in runs[keep:]])


def run_alert_cycle(spark: SparkSession, store: Store, now: datetime | str, run_id: str) -> dict[str, int]:
    """One stored alert cycle; returns how many incidents it created and how many groups must wait.

    A cycle reads the state its predecessor left (waiting anomalies, last firing of each series, marks) and the
    anomalies of the batches above the marks, not the whole history. Batches of a stream follow each other, so one mark
    a stream says which are taken. Cycles follow each other by a running number, not by the caller's clock.
    A cycle that broke off is repeated under the same run id.
    """
    done = store.runs(spark, "cycles").where(F.col("run_id") != run_id)
    last = done.agg(F.max(F.struct("seq", "run_id")).alias("c")).first()["c"]
    before = F.col("run_id") == (last["run_id"] if last else "")
    marks = {r["stream"]: r["taken_to"] for r in store.runs(spark, "cycle_marks").where(before).collect()}
    new = complete_to(spark, store, marks)
    fresh = taken_anomalies(spark, store, marks, new)
    waiting = store.runs(spark, "waiting").where(before).drop("run_id").unionByName(fresh)
    fired = store.runs(spark, "fired").where(before).drop("run_id")
    nobody = spark.createDataFrame([], schemas.INCIDENT_MEMBER)
    result = alert_cycle(waiting, nobody, fired, now)
    members = result.members.select(schemas.INCIDENT_MEMBER.names)
    save_run(members, store.root, "incident_members", run_id)
    save_run(result.incidents.select(schemas.INCIDENT.names), store.root, "incidents", run_id)
    firings = fired.unionByName(result.fired.select(FIRED.names))
    save_run(firings.groupBy(*SERIES).agg(F.max("last_fired").alias("last_fired")), store.root, "fired", run_id)
    taken = spark.createDataFrame(list((marks | new).items()), CYCLE_MARKS).coalesce(1)
    save_run(taken, store.root, "cycle_marks", run_id)
    stored = store.runs(spark, "incident_members").where(F.col("run_id") == run_id)
    save_run(waiting.join(stored.select("anomaly_id"), "anomaly_id", "left_anti").select(schemas.ANOMALY.names), store.root, "waiting", run_id)
    seq = last["seq"] + 1 if last else 0
    cycle = spark.range(1).select(F.lit(str(now)).cast("timestamp").alias("at"), F.lit(seq).cast("bigint").alias("seq"))
    save_run(cycle, store.root, "cycles", run_id)
    return result.counts.first().asDict()
