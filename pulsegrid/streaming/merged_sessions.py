"""Stored incidents that grow and merge when anomalies come late; an id, once given, stays resolvable.

A batch touches only the stored sessions near its own. A session that it extends keeps its id, even if it now starts
earlier; of sessions that it joins, the earliest keeps its id and the others become aliases of it. The log is
append-only: versions of sessions and aliases, each with the running number of its batch; the newest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import deterministic_id
from pulsegrid.operators.incidents import _slot, session_slots
from pulsegrid.session import broadcast_if_small, cut_lineage
from pulsegrid.sources.tables import delete_paths, ensure_table, load_runs, save_run
from pulsegrid.streaming.jobs import batch_run, event_time, stream_name

SERIES = ("service", "metric")
SPAN = ("first_us", "last_us", "n")
LOG, MEMBERS = "session_log", "session_members"
# With ``survivor_id`` a row says that an id goes on as another, without it is a version of a session.
LOG_ROW = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("incident_id", *SERIES)] + [T.StructField(name, T.LongType()) for name in SPAN]
    + [T.StructField("survivor_id", T.StringType()), T.StructField("seq", T.LongType())]
)
MEMBER = T.StructType([T.StructField("anomaly_id", T.StringType()), T.StructField("incident_id", T.StringType())])


def prepare(spark: SparkSession, root: str) -> None:
    for table, schema in ((LOG, LOG_ROW), (MEMBERS, MEMBER)):
        ensure_table(spark, f"{root}/{table}/run_id=none", schema)


def _log(spark: SparkSession, root: str, without_run: str = "") -> DataFrame:
    return load_runs(spark, root, LOG, LOG_ROW).where(F.col("run_id") != without_run).drop("run_id")


def _aliases(log: DataFrame) -> DataFrame:
    rows = log.where("survivor_id IS NOT NULL")
    return rows.groupBy("incident_id").agg(F.max_by("survivor_id", "seq").alias("survivor_id"))


def _live(log: DataFrame) -> DataFrame:
    newest = log.where("survivor_id IS NULL").groupBy("incident_id").agg(F.max_by(F.struct(*SERIES, *SPAN), "seq").alias("v"))
    return newest.select("incident_id", "v.*").join(_aliases(log).select("incident_id"), "incident_id", "left_anti")


def live_sessions(spark: SparkSession, root: str) -> DataFrame:
    """incident_id, series, first_us, last_us and n of every session as known by now; no two lie within the gap."""
    return _live(_log(spark, root))


def resolve_ids(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with every incident_id replaced by the one it lives on as; an id never merged stays, and so does an unknown one."""
    survivors = _aliases(_log(rows.sparkSession, root))
    found = rows.join(broadcast_if_small(survivors), "incident_id", "left")
    return found.withColumn("incident_id", F.coalesce("survivor_id", "incident_id")).select(*rows.columns)


def session_members(spark: SparkSession, root: str) -> DataFrame:
    """(anomaly_id, incident_id) under the ids that live now."""
    return resolve_ids(load_runs(spark, root, MEMBERS, MEMBER).drop("run_id"), root)


def merge_sessions(stored: DataFrame, new: DataFrame, gap_seconds: int) -> DataFrame:
    """Both kinds with ``kept_id``, the id of the session each now belongs to; ``new`` has no incident_id yet.

    An interval union in order of time; a distance equal to the gap joins. A series has at most time span / gap rows of
    either kind. Without a stored session the id is that of the batch grouping.
    """
    both = stored.select(*SERIES, *SPAN, "incident_id").unionByName(new.select(*SERIES, *SPAN, F.lit(None).cast("string").alias("incident_id")))
    ordered = Window.partitionBy(*SERIES).orderBy("first_us", "last_us", "incident_id")
    reach = F.max("last_us").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("first_us") - reach > gap_seconds * 1_000_000)
    started = F.max(F.when(F.col("opens"), F.col("first_us"))).over(ordered)
    grouped = both.withColumn("opens", opens).withColumn("started_us", started).drop("opens")
    whole = Window.partitionBy(*SERIES, "started_us")
    earliest = F.min(F.when(F.col("incident_id").isNotNull(), F.struct("first_us", "incident_id"))).over(whole)
    return grouped.withColumn("kept_id", F.coalesce(earliest["incident_id"], deterministic_id("incident", *SERIES, "started_us")))


def session_batch(root: str, gap_seconds: int = V.GROUPING_SECONDS) -> Callable[[DataFrame, int], None]:
    """Micro-batch of new anomalies, however late: store how sessions grew and merged, and the members.

    One batch at a time writes to a store. A repeated batch does not see what its first attempt stored and replaces it.
    An anomaly must come once (as ``insert_anomalies`` passes it on); one without a time belongs to no session.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = batch_run(stream_name(spark), batch_id)
        rows = event_time(batch).where("timestamp IS NOT NULL").select("anomaly_id", *SERIES, "timestamp").persist()
        try:
            slots = cut_lineage(session_slots(rows, gap_seconds))
            new = slots.groupBy(*SERIES, "started_us").agg(
                F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
            )
            gap_us = gap_seconds * 1_000_000
            near = new.groupBy(*SERIES).agg((F.min("first_us") - gap_us).alias("a"), (F.max("last_us") + gap_us).alias("b"))
            log = _log(spark, root, run_id)
            stored = _live(log).join(broadcast_if_small(near), list(SERIES)).where("last_us >= a AND first_us <= b")
            merged = cut_lineage(merge_sessions(stored, new, gap_seconds))
            seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
            save_run(_changes(merged, _aliases(log), seq), root, LOG, run_id)
            fresh = merged.where("incident_id IS NULL").select(*SERIES, F.col("first_us").alias("started_us"), F.col("kept_id").alias("incident_id"))
            placed = slots.drop("incident_id").join(fresh, [*SERIES, "started_us"]).select(*SERIES, "slot", "incident_id")
            members = rows.withColumn("slot", _slot(gap_seconds)).join(broadcast_if_small(placed), [*SERIES, "slot"])
            save_run(members.select("anomaly_id", "incident_id"), root, MEMBERS, run_id)
        finally:
            rows.unpersist()

    return each


def _changes(merged: DataFrame, aliases: DataFrame, seq: int) -> DataFrame:
    """Log rows of a batch: grown or new sessions, absorbed ids, and earlier aliases of those, so that one look resolves."""
    grown = merged.groupBy(F.col("kept_id").alias("incident_id"), *SERIES).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.count_if(F.col("incident_id").isNull()).alias("added")
    )
    absorbed = merged.where("incident_id <> kept_id").select("incident_id", F.col("kept_id").alias("survivor_id"))
    earlier = aliases.withColumnRenamed("survivor_id", "via").join(absorbed.withColumnRenamed("incident_id", "via"), "via").drop("via")
    rows = grown.where("added > 0").drop("added").unionByName(absorbed.unionByName(earlier), allowMissingColumns=True)
    return rows.withColumn("seq", F.lit(seq).cast("bigint")).select(LOG_ROW.names)


def compact_sessions(spark: SparkSession, root: str) -> int:
    """Replace the log by one run with the live sessions and resolved aliases; returns the folders deleted.

    The snapshot is written first and repeats rows under the newest number, so readers, and a compaction that broke off,
    come out the same. Not while a batch is running, and only after its last one is complete: a batch repeated after it counts twice.
    """
    log = load_runs(spark, root, LOG, LOG_ROW)
    old = [r["run_id"] for r in log.select("run_id").distinct().collect()]  # one a batch since the last compaction
    seq = log.agg(F.max("seq")).first()[0]
    if seq is None:
        return 0
    rows = _live(log).unionByName(_aliases(log), allowMissingColumns=True).withColumn("seq", F.lit(seq).cast("bigint"))
    name = f"s-{seq:012d}"
    if name in old:
        return 0
    save_run(rows.select(LOG_ROW.names), root, LOG, name)
    return delete_paths(spark, [f"{root}/{LOG}/run_id={run}" for run in old])
