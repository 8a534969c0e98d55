"""The registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators import daily_sketches, evaluation, incidents, ingest, overview, registry, rollup, schedule, schedule_index, scoring
from pulsegrid.plans import detection, training
from pulsegrid.plans.fixtures import AS_OF, GAP, SIM_START, World
from pulsegrid.session import broadcast_if_small, cut_lineage, shared_folder
from pulsegrid.sources import tables
from pulsegrid.sources.adapters import lineitem_readings
from pulsegrid.sources.key_index import KeyIndex, insert_indexed as insert_by_index
from pulsegrid.streaming import jobs, merged_sessions, refreshed_rollup, suppression
from pulsegrid.streaming.queue_source import drain_queue

Query = Callable[[SparkSession, str], DataFrame]
SERIES = ("service", "metric")
QUERIES: dict[str, Query] = {}
SEGMENT_MESSAGES = 200_000  # messages that are written as one segment of a queue, where there are many


def query(build: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(World(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def new_folder(w: World) -> str:
    return f"{shared_folder(w.spark)}/pulsegrid-{uuid.uuid4().hex}"


def r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


def rounded_points(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_value", F.round("avg_value", 4))


# --- ingest -------------------------------------------------------------------------------------


@query
def metric_events(w: World) -> DataFrame:
    return w.events.withColumn("labels", S.labels_to_json("labels"))


@query
def parse_events(w: World) -> DataFrame:
    p = ingest.parse_events(w.messages)
    good = {c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("event_id", *SERIES, "value")}
    good["timestamp"] = F.when(F.col("reason").isNull(), F.col("timestamp").cast("timestamp_ntz"))
    return p.withColumns(good).select("msg_id", *good, "reason")


@query
def validate_events(w: World) -> DataFrame:
    valid, rejected = ingest.validate_events(ingest.parse_events(w.messages))
    return rejected.groupBy("reason").agg(F.count("data").alias("n")).unionByName(
        valid.agg(F.lit("valid").alias("reason"), F.count(F.lit(1)).alias("n"))
    )


@query
def accept_request(w: World) -> DataFrame:
    request = F.floor(F.col("msg_id") / 400).cast("bigint")
    return ingest.accept_request(ingest.parse_events(w.messages.withColumn("request", request)), "request")


@query
def dedupe_first(w: World) -> DataFrame:
    valid, _ = ingest.validate_events(ingest.parse_events(w.messages))
    return ingest.dedupe_first(valid.drop("labels", "timestamp"), ["event_id"], ["msg_id"])


@query
def insert_if_absent(w: World) -> DataFrame:
    stored = w.readings.where(F.col("timestamp") < S.time_literal(w.readings, "timestamp", "2024-01-20 00:00:00"))
    valid, _ = ingest.validate_events(ingest.parse_events(w.messages))
    batch = valid.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    new = ingest.insert_if_absent(stored, batch, ["timestamp", "event_id"], ["msg_id"])
    return new.select("msg_id", "event_id", "timestamp", *SERIES, "value")


@query
def insert_indexed(w: World) -> DataFrame:
    """As insert_if_absent into a stored table, whose days are opened only where its key index has a key of the batch."""
    folder = new_folder(w)
    early = w.events.where(F.col("timestamp") < S.time_literal(w.events, "timestamp", "2024-01-20 00:00:00"))
    tables.write_metrics_table(early, f"{folder}/metrics")
    stored = tables.read_metrics_table(w.spark, f"{folder}/metrics", schemas.T.StructType(w.events.schema.fields))
    index = KeyIndex(f"{folder}/keys")
    index.build(w.spark, stored)
    valid, _ = ingest.validate_events(ingest.parse_events(w.messages))
    batch = cut_lineage(valid.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).drop("labels"))
    new = insert_by_index(stored, index, batch, ["timestamp", "event_id"], ["msg_id"])
    return new.select("msg_id", "event_id", "timestamp", *SERIES, "value")


@query
def insert_anomalies(w: World) -> DataFrame:
    a = w.anomalies
    stored = a.where(F.col("timestamp") < S.time_literal(a, "timestamp", "2024-01-15 00:00:00"))
    again = a.withColumn("anomaly_id", F.concat(F.lit("z"), "anomaly_id"))
    new = ingest.insert_anomalies(stored, a.unionByName(again).drop("status"))
    return new.select("anomaly_id", "event_id", "timestamp", "status", r("score"))


@query
def batch_accounting(w: World) -> DataFrame:
    stored = w.readings.where(F.col("timestamp") < S.time_literal(w.readings, "timestamp", "2024-01-10 00:00:00"))
    batches = w.messages.withColumn("batch", F.floor(F.col("msg_id") / 1000).cast("bigint"))
    parsed = ingest.parse_events(batches).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return ingest.batch_accounting(parsed, stored, "batch")


@query
def completeness_audit(w: World) -> DataFrame:
    return ingest.completeness_audit(
        w.readings, w.series, "2024-01-10 00:00:00", "2024-01-20 00:00:00", 7200
    )


@query
def write_metrics_table(w: World) -> DataFrame:
    path = new_folder(w)
    tables.write_metrics_table(w.events, path)
    schema = schemas.T.StructType(w.events.schema.fields)
    stored = tables.read_metrics_table(w.spark, path, schema)
    return stored.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query
def jsonl_round_trip(w: World) -> DataFrame:
    path = new_folder(w)
    tables.write_jsonl(w.events, path)
    back = tables.read_jsonl(w.spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn(
        "labels", S.labels_to_json("labels")
    )


@query
def save_and_load_tables(w: World) -> DataFrame:
    root = new_folder(w)
    half = S.time_literal(w.opened, "started_at", "2024-01-16 00:00:00")
    tables.save_run(w.opened.where(F.col("started_at") < half), root, "incidents", "r1")
    for _ in range(2):
        tables.save_run(w.opened.where(F.col("started_at") >= half), root, "incidents", "r2")
    schema = schemas.T.StructType(w.opened.schema.fields)
    back = tables.load_runs(w.spark, root, "incidents", schema)
    return back.groupBy("run_id", *SERIES).agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first"))


# --- projections and reads ----------------------------------------------------------------------


@query
def load_series(w: World) -> DataFrame:
    return evaluation.load_series(w.readings, "svc-1", "click", "2024-01-05 00:00:00", "2024-01-25 00:00:00")


@query
def discover_pairs(w: World) -> DataFrame:
    return evaluation.discover_pairs(w.readings, "2024-01-30 12:00:00")


@query
def optional_filter(w: World) -> DataFrame:
    parts = [
        overview.optional_filter(w.incidents, "status", value).groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n")).withColumn("filter", F.lit(value or "none"))
        for value in (None, "open", "resolved")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def out_of_range_readings(w: World) -> DataFrame:
    return rollup.out_of_range_readings(w.readings, "2024-01-25 06:00:00", max_days=14)


@query
def parse_iso_utc(w: World) -> DataFrame:
    ts, kind = F.col("timestamp"), S.hash60("event_id") % 6
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(kind == 0, plain).when(kind == 1, F.concat(plain, F.lit("Z")))
        .when(kind == 2, F.concat(plain, F.lit("+02:00"))).when(kind == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(F.lit("at "), plain))
    )
    rows = w.readings.select("event_id", text.alias("text"))
    return rows.select("event_id", S.parse_iso_utc("text").cast("timestamp_ntz").alias("parsed"))


@query
def health_status(w: World) -> DataFrame:
    opened = w.incidents.groupBy(*SERIES).agg(F.count_if(F.col("status") == "open").alias("n"))
    days = w.readings.groupBy("service").agg(F.countDistinct("metric").alias("n")).select("service", F.lit("all").alias("metric"), "n")
    return opened.unionByName(days).withColumn("health", S.health_status("n"))


@query
def score_tier(w: World) -> DataFrame:
    return registry.with_score_tier(w.registry).select("model_id", "eval_f1", "tier")


@query
def is_anomaly(w: World) -> DataFrame:
    limits = F.array(*[F.lit(v) for v in (-100.0, -50.0, 0.0, 25.0)])
    rows = w.scored.select("metric", "score", F.explode(limits).alias("threshold"))
    return rows.groupBy("metric", "threshold").agg(F.count_if(S.is_anomaly("score", "threshold")).alias("n"))


@query
def rethreshold(w: World) -> DataFrame:
    return scoring.rethreshold(w.anomalies, -40.0)


@query
def resolved_flag(w: World) -> DataFrame:
    linked = incidents.link_members(w.anomalies, w.members).drop("status")
    status = F.coalesce("status", F.lit("open"))
    return linked.join(w.incidents.select("incident_id", "status"), "incident_id", "left").select(
        "anomaly_id", S.resolved_flag(status).alias("resolved")
    )


@query
def status_domain_audit(w: World) -> DataFrame:
    odd = F.when(S.hash60("incident_id") % 7 == 0, F.lit("closed")).otherwise(F.col("status"))
    return incidents.status_domain_audit(w.incidents.withColumn("status", odd))


@query
def series_points_auto_short(w: World) -> DataFrame:
    args = ("svc-2", "view", "2024-01-10 00:00:00", "2024-01-10 02:00:00")
    return rounded_points(rollup.series_points_auto(w.readings, rollup.rollup_1min(w.readings), *args))


@query
def series_points_auto_long(w: World) -> DataFrame:
    args = ("svc-2", "view", "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    return rounded_points(rollup.series_points_auto(w.readings, rollup.rollup_1min(w.readings), *args))


@query
def metrics_for_service(w: World) -> DataFrame:
    return registry.metrics_for_service(w.registry, "svc-3")


@query
def relative_window(w: World) -> DataFrame:
    parts = [
        rollup.relative_window(w.readings, p, "2024-01-30 12:00:00").groupBy("service")
        .agg(F.count(F.lit(1)).alias("n")).withColumn("preset", F.lit(p))
        for p in ("1h", "3h", "24h", "7d")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def ungrouped_anomalies(w: World) -> DataFrame:
    rows = incidents.ungrouped_anomalies(w.anomalies, w.members)
    return rows.select("anomaly_id", *SERIES, "timestamp").orderBy(*SERIES, "timestamp")


@query
def fresh_ungrouped(w: World) -> DataFrame:
    rows = incidents.fresh_ungrouped(
        w.anomalies, w.members, "2024-01-20 00:00:00", "svc-1", "error", max_age_seconds=864_000
    )
    return rows.select("anomaly_id", *SERIES, "timestamp")


# --- joins --------------------------------------------------------------------------------------


@query
def service_overview(w: World) -> DataFrame:
    return overview.service_overview(w.readings, w.incidents, w.anomalies)


@query
def incident_feed(w: World) -> DataFrame:
    return overview.incident_feed(w.incidents, w.members, limit=50, offset=10)


@query
def attach_current_model(w: World) -> DataFrame:
    rows = scoring.attach_current_model(w.readings, registry.current_models(w.pointers))
    return rows.groupBy(*SERIES, "model_id").agg(F.count(F.lit(1)).alias("n"))


@query
def apply_anomaly_schedule(w: World) -> DataFrame:
    rows = schedule.apply_anomaly_schedule(w.readings, w.windows)
    return rows.select("event_id", "value", "is_anomalous")


@query
def apply_default_schedule(w: World) -> DataFrame:
    """The default schedule under the names of the given series: readings it changes, and by how much."""
    windows = schedule.offset_to_window(w.default_schedule, SIM_START, "timestamp_ntz")
    rows = schedule.apply_anomaly_schedule(w.readings, windows)
    moved = F.round(F.sum(F.col("value") - F.col("base_value")), 3)
    return rows.groupBy(*SERIES, "spec_idx").agg(F.count(F.lit(1)).alias("n"), moved.alias("moved"))


@query
def first_matching_spec(w: World) -> DataFrame:
    rows = schedule.apply_anomaly_schedule(w.readings, w.windows)
    return rows.groupBy(*SERIES, "spec_idx").agg(F.count(F.lit(1)).alias("n"))


@query
def injected_count(w: World) -> DataFrame:
    return schedule.injected_count(schedule.apply_anomaly_schedule(w.readings, w.windows))


@query
def score_against_truth(w: World) -> DataFrame:
    rows = w.scored.withColumn("flag", S.is_anomaly("score", 0.0))
    out = schedule.score_against_truth(rows, w.windows, "flag")
    return out.select(*SERIES, "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


def _many_windows(w: World) -> DataFrame:
    """One window for every second reading of a series, overlapping, of up to 55 hours; some rows of a schedule tie."""
    h = S.hash60("event_id")
    kind = F.get(F.array(*[F.lit(t) for t in V.ANOMALY_TYPES]), (h % len(V.ANOMALY_TYPES)).cast("int"))
    start = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    seconds = (h % 200_000).cast("double")
    return w.readings.where(h % 2 == 0).select(
        (h % 1009).alias("spec_idx"), *SERIES, kind.alias("anomaly_type"), start.alias("start"),
        S.shift_seconds(start, seconds).alias("end"), seconds.alias("duration_seconds"), (h % 7 + F.lit(0.25)).alias("magnitude"),
    )


@query
def schedule_indexed(w: World) -> DataFrame:
    rows = schedule_index.apply_schedule_indexed(w.readings, _many_windows(w))
    return rows.select("event_id", "spec_idx", "is_anomalous", "value")


@query
def score_against_truth_indexed(w: World) -> DataFrame:
    rows = w.scored.withColumn("flag", S.is_anomaly("score", 0.0))
    out = schedule_index.score_against_truth_indexed(rows, w.windows, "flag")
    return out.select(*SERIES, "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


@query
def annotate_buckets_exact(w: World) -> DataFrame:
    at = w.readings.select(*SERIES, F.col("timestamp").alias("bucket"), "event_id")
    out = rollup.annotate_buckets(at, w.anomalies)
    return out.select("event_id", "anomaly_value", r("anomaly_score"))


@query
def annotate_buckets_aligned(w: World) -> DataFrame:
    points = rollup.rollup(w.readings, "1 hour")
    out = rollup.annotate_buckets(points, w.anomalies, "1 hour", align=True)
    return out.select(*SERIES, "bucket", "sample_count", "anomaly_value", r("anomaly_score"))


@query
def incident_of_event(w: World) -> DataFrame:
    out = incidents.incident_of_event(w.readings, w.anomalies, w.members, w.incidents)
    return out.withColumn("score", F.round("score", 4))


@query
def link_members(w: World) -> DataFrame:
    return incidents.link_members(w.anomalies, w.members).select("anomaly_id", "event_id", "incident_id")


# --- aggregates ---------------------------------------------------------------------------------


@query
def rollup_1min(w: World) -> DataFrame:
    return rounded_points(rollup.rollup_1min(w.readings))


@query
def rollup_10s(w: World) -> DataFrame:
    out = rollup.rollup_10s(w.readings, "svc-0", "signup", "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    return rounded_points(out)


@query
def rebuild_rollup(w: World) -> DataFrame:
    return rounded_points(rollup.rebuild_rollup(w.readings, "2024-01-08 00:00:00", "2024-01-22 00:00:00"))


@query
def rollup_lineitem(w: World) -> DataFrame:
    points = rollup.rollup_1min(lineitem_readings(w.table("lineitem")))
    return points.withColumn("total", F.round(F.col("avg_value") * F.col("sample_count"), 2)).drop("avg_value")


@query
def open_incident_counts(w: World) -> DataFrame:
    return overview.open_incident_counts(w.incidents)


@query
def last_anomaly_at(w: World) -> DataFrame:
    return overview.last_anomaly_at(w.anomalies)


@query
def incident_anomaly_count(w: World) -> DataFrame:
    return overview.incident_anomaly_count(w.incidents, w.members).select("incident_id", "status", "anomaly_count")


@query
def avg_f1_evaluated(w: World) -> DataFrame:
    return registry.avg_f1_evaluated(w.registry).withColumn("avg_f1", F.round("avg_f1", 4))


@query
def registry_audit(w: World) -> DataFrame:
    return registry.registry_audit(w.registry)


@query
def score_range_audit(w: World) -> DataFrame:
    odd = F.when(S.hash60("model_id") % 9 == 0, F.col("eval_recall") + 1.0).otherwise(F.col("eval_recall"))
    return registry.score_range_audit(w.registry.withColumn("eval_recall", odd))


@query
def confusion_scores(w: World) -> DataFrame:
    rows = evaluation.inject_anomalies(w.readings, seed=7).withColumn("cut_at", F.col("value") > 120.0)
    out = evaluation.confusion_scores(rows.withColumn("predicted", F.when(F.col("cut_at"), 1).otherwise(0)))
    return out.select(*SERIES, "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


@query
def contamination_offset(w: World) -> DataFrame:
    return scoring.contamination_offset(w.scored).select(*SERIES, r("offset"))


@query
def incident_members_agg(w: World) -> DataFrame:
    return incidents.incident_members_agg(w.anomalies, w.members)


@query
def incident_member_list(w: World) -> DataFrame:
    return incidents.incident_member_list(w.anomalies, w.members)


@query
def anomalies_in_window(w: World) -> DataFrame:
    return rollup.anomalies_in_window(w.anomalies, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


# --- ordered operators --------------------------------------------------------------------------


def _grouped(w: World, gap: int) -> DataFrame:
    out = incidents.group_incidents(w.anomalies, gap)
    return out.select("incident_id", *SERIES, "started_at", "last_at", "n_anomalies")


@query
def group_incidents_600(w: World) -> DataFrame:
    return _grouped(w, 600)


@query
def group_incidents_36000(w: World) -> DataFrame:
    return _grouped(w, GAP)


@query
def incident_members(w: World) -> DataFrame:
    return w.all_members


@query
def chrono_split(w: World) -> DataFrame:
    return evaluation.chrono_split(w.readings).select("event_id", "part")


@query
def min_sample_gate(w: World) -> DataFrame:
    hourly = w.readings.withColumn("metric", F.concat_ws("@", "metric", F.date_format("timestamp", "yyyy-MM-dd")))
    return evaluation.min_sample_gate(hourly, 14).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))


@query
def current_models(w: World) -> DataFrame:
    return registry.current_models(w.pointers)


@query
def rollback_model(w: World) -> DataFrame:
    own = w.versions.where((F.col("service") == "svc-2") & (F.col("metric") == "click"))
    model_id = own.agg(F.min(F.struct("trained_at", "model_id")).alias("m")).first()["m"]["model_id"]
    back = registry.rollback_model(w.versions, "svc-2", "click", model_id, "2024-02-01 00:00:00", 20)
    return registry.current_models(w.pointers.unionByName(back))


@query
def sample_rows(w: World) -> DataFrame:
    return evaluation.sample_rows(w.readings, seed=42).select("event_id", "sampled")


@query
def inject_anomalies(w: World) -> DataFrame:
    return evaluation.inject_anomalies(w.readings, seed=42).select("event_id", r("value", 3), "truth")


@query
def suppress_cooldown(w: World) -> DataFrame:
    return incidents.suppress_cooldown(w.opened, 172_800)


@query
def resolve_incident(w: World) -> DataFrame:
    late = w.opened.where(F.col("started_at") >= S.time_literal(w.opened, "started_at", "2024-01-25 00:00:00"))
    closing = incidents.resolve_incident(w.opened, late, AS_OF, 2)
    return incidents.current_incidents(w.opened, w.status_events.unionByName(closing))


@query
def alert_cycle(w: World) -> DataFrame:
    out = incidents.alert_cycle(w.anomalies, w.members, w.fired, AS_OF, GAP)
    return out.incidents.drop("resolved_at")


@query
def alert_cycle_members(w: World) -> DataFrame:
    return incidents.alert_cycle(w.anomalies, w.members, w.fired, AS_OF, GAP).members


@query
def alert_cycle_counts(w: World) -> DataFrame:
    return incidents.alert_cycle(w.anomalies, w.members, w.fired, AS_OF, GAP).counts


# --- pages --------------------------------------------------------------------------------------


@query
def series_points(w: World) -> DataFrame:
    one = rollup.of_series(w.readings, "svc-4", "error")
    return rounded_points(rollup.series_points(rollup.rollup_1min(one)))


@query
def incident_page(w: World) -> DataFrame:
    return overview.incident_page(w.incidents, "resolved", limit=40, offset=5)


@query
def model_list(w: World) -> DataFrame:
    out = registry.model_list(w.registry).select("model_id", *SERIES, "trained_at", "n_samples", "eval_f1", "is_current")
    return out


@query
def model_list_current(w: World) -> DataFrame:
    out = registry.model_list(w.registry, "svc-1", current_only=True)
    return out.select("model_id", *SERIES, "trained_at", "window_start", "window_end", "n_samples")


@query
def recent_open_incidents(w: World) -> DataFrame:
    return overview.recent_open_incidents(w.incidents, w.members).drop("resolved_at")


@query
def service_open_incidents(w: World) -> DataFrame:
    return overview.service_open_incidents(w.incidents, w.members, "svc-1").drop("resolved_at")


@query
def service_open_incidents_paged(w: World) -> DataFrame:
    return overview.service_open_incidents(w.incidents, w.members, "svc-1", filter_first=True).drop("resolved_at")


@query
def anomaly_markers(w: World) -> DataFrame:
    out = rollup.anomaly_markers(w.anomalies, "svc-3", "purchase", "2024-01-05 00:00:00", "2024-01-28 00:00:00")
    return out.withColumn("score", F.round("score", 4))


# --- scalar functions ---------------------------------------------------------------------------


@query
def time_bucket(w: World) -> DataFrame:
    minute = w.readings.select("event_id", "timestamp", S.time_bucket("timestamp", "1 minute").alias("minute"))
    return minute.select("event_id", "minute", S.time_bucket("timestamp", "10 seconds").alias("ten"))


@query
def seasonality(w: World) -> DataFrame:
    profile = rollup.seasonal_profile(w.readings)
    return profile.select(*SERIES, "part", "step", F.round("factor", 6).alias("factor"))


@query
def expected_baseline(w: World) -> DataFrame:
    out = rollup.expected_baseline(w.readings, rollup.seasonal_profile(w.readings))
    return out.select("event_id", r("baseline"))


@query
def labels_round_trip(w: World) -> DataFrame:
    return w.labels_json.select("event_id", S.labels_to_map("labels")["k"].alias("k"))


@query
def offset_to_window(w: World) -> DataFrame:
    return w.windows


@query
def ground_truth_windows(w: World) -> DataFrame:
    path = new_folder(w)
    tables.write_ground_truth(schedule.ground_truth_windows(w.windows), path)
    text = "service string, metric string, anomaly_type string, start string, `end` string, duration_seconds double, magnitude double"
    back = w.spark.read.schema(text).json(path)
    for name in ("start", "end"):
        back = back.withColumn(name, S.parse_iso_utc(name).cast("timestamp_ntz"))
    return back


@query
def predict(w: World) -> DataFrame:
    rows = w.scored.withColumn("prediction", S.predict("score"))
    return rows.select("event_id", "prediction", S.remap_prediction("prediction").alias("label"))


@query
def deterministic_id(w: World) -> DataFrame:
    return w.readings.select("event_id", S.deterministic_id("event", *SERIES, "event_id").alias("id"))


@query
def rank_detector(w: World) -> DataFrame:
    return w.scored.select("event_id", r("score"))


# --- models (checked by rows and by the tests) ----------------------------------------------------


@query
def fit_isolation_forest(w: World) -> DataFrame:
    split = training.split_window(w.readings, AS_OF)
    out = scoring.fit_isolation_forest(split.train, sizes=split.train_sizes)
    return out.select(*SERIES, "n_fit", (F.size("scores") == F.size("edges") + 1).alias("whole"))


@query
def model_fit_stats(w: World) -> DataFrame:
    return training.train_all(w.readings, AS_OF).versions.select(
        *SERIES, "n_samples", F.col("fit_seconds").between(0.0, 3600.0).alias("timed")
    )


def _fitted(w: World) -> tuple[DataFrame, DataFrame]:
    """Readings with their model's id, and the surfaces."""
    models = training.fit_models(training.split_window(w.readings, AS_OF), AS_OF)
    return scoring.attach_current_model(w.readings, models), models


def _looked_up(readings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Scores by SQL functions alone: the step of a reading is the number of edges below it, found by halving."""
    joined = readings.join(broadcast_if_small(surfaces.select("model_id", "edges", "scores", "offset")), "model_id")

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = (at["low"] < at["high"]) & (F.get("edges", middle) < F.col("value"))
        low = F.when(right, middle + 1).otherwise(at["low"])
        return F.struct(low.alias("low"), F.when(right, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size("edges") + 1)).cast("int"))
    below = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size("edges").alias("high")), halve)["low"]
    return joined.select("event_id", *SERIES, (F.get("scores", below) - F.col("offset")).alias("expected"))


def _score_check(w: World, max_edges: int | None = None) -> DataFrame:
    readings, surfaces = _fitted(w)
    scored = scoring.score_events(readings, surfaces, max_edges=max_edges).select("event_id", "score")
    both = _looked_up(readings, surfaces).join(scored, "event_id", "left")
    wrong = F.col("score").isNull() | (F.abs(F.col("score") - F.col("expected")) > 1e-9)
    return both.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong"))


@query
def score_events(w: World) -> DataFrame:
    """Every score beside one looked up by other means."""
    return _score_check(w)


@query
def score_events_sorted(w: World) -> DataFrame:
    """The same for the way without a broadcast."""
    return _score_check(w, max_edges=-1)


@query
def evaluate_holdout(w: World) -> DataFrame:
    split = training.split_window(w.readings, AS_OF)
    scores = training.evaluate_holdout(split, training.fit_models(split, AS_OF))
    unit = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1")]
    agrees = F.abs(F.col("f1") * (2 * F.col("tp") + F.col("fp") + F.col("fn")) - 2 * F.col("tp")) < 1e-9
    return scores.select(*SERIES, (F.col("tp") + F.col("fn")).alias("n_injected"), (unit[0] & unit[1] & unit[2] & agrees).alias("sound"))


@query
def trained_quality(w: World) -> DataFrame:
    """The quality gate on models that were trained here, not on stored figures."""
    run = training.train_all(w.readings, AS_OF)
    gate = registry.avg_f1_evaluated(registry.with_current_flag(run.versions, run.pointers))
    f1 = F.col("avg_f1")
    return gate.select("n_evaluated", f1.between(0.2, 1.0).alias("useful"), (F.col("passes") == (f1 >= 0.6)).alias("gate_agrees"))


@query
def train_all(w: World) -> DataFrame:
    run = training.train_all(w.readings, AS_OF)
    positives = run.evaluation.select(*SERIES, (F.col("tp") + F.col("fn")).alias("n_injected"))
    rows = registry.with_current_flag(run.versions, run.pointers).join(positives, list(SERIES))
    unit = [F.col(c).between(0.0, 1.0) for c in ("eval_precision", "eval_recall", "eval_f1")]
    return rows.withColumn("evaluated", unit[0] & unit[1] & unit[2]).drop(
        "fit_seconds", "eval_precision", "eval_recall", "eval_f1"
    )


@query
def save_and_load_models(w: World) -> DataFrame:
    root = new_folder(w)
    run = training.train_all(w.readings, AS_OF)
    tables.save_models(run.surfaces, root, "r1")
    back = tables.load_models(w.spark, root, schemas.SCORE_SURFACE)
    digest = F.xxhash64("edges", "scores", "offset")
    kept = run.surfaces.select("model_id", *SERIES, digest.alias("a")).join(back.select("model_id", digest.alias("b")), "model_id")
    return kept.select(*SERIES, (F.col("a") == F.col("b")).alias("same"))


def _detect_check(w: World, found: DataFrame, run: training.TrainingRun) -> DataFrame:
    """Anomalies per series against scores looked up by other means, and whether they are few."""
    readings = scoring.attach_current_model(w.readings, registry.current_models(run.pointers))
    judged = _looked_up(readings, run.surfaces).select("event_id", *SERIES, (F.col("expected") < 0).alias("wanted"))
    hits = found.select("event_id", *SERIES, F.lit(True).alias("hit"))
    both = judged.join(hits, ["event_id", *SERIES], "full")
    hit, wanted = F.coalesce("hit", F.lit(False)), F.coalesce("wanted", F.lit(False))
    n = F.count(F.lit(1))
    return both.groupBy(*SERIES).agg(
        n.alias("n_readings"), F.count_if(wanted & ~hit).alias("n_missed"), F.count_if(hit & ~wanted).alias("n_extra"),
        (F.count_if(hit) <= F.ceil(n * 0.15)).alias("few"),
    )


def _figures(df: DataFrame) -> DataFrame:
    """One row per column of a single-row table."""
    rows = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in df.columns])
    return df.select(F.explode(rows).alias("x")).select("x.what", "x.n")


@query
def detect(w: World) -> DataFrame:
    run = training.train_all(w.readings, AS_OF)
    return _detect_check(w, detection.detect(w.readings, registry.current_models(run.pointers), run.surfaces), run)


@query
def detect_sorted(w: World) -> DataFrame:
    """The same for the way without a broadcast of surfaces."""
    run = training.train_all(w.readings, AS_OF)
    return _detect_check(w, detection.detect(w.readings, registry.current_models(run.pointers), run.surfaces, max_edges=-1), run)


@query
def history_to_overview(w: World) -> DataFrame:
    return detection.history_to_overview(w.readings, AS_OF)


# --- streams ------------------------------------------------------------------------------------


def _event_stream(w: World) -> DataFrame:
    from pulsegrid.sources.adapters import metric_events as adapt

    raw = w.table("events")
    return adapt(jobs.read_table_stream(w.spark, w.sf_dir, "events.parquet", raw.schema))


def _finish(w: World, stream: DataFrame) -> DataFrame:
    folder = new_folder(w)
    jobs.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = w.spark.read.schema(stream.schema).parquet(f"{folder}/out")
    zoned = [f.name for f in out.schema.fields if isinstance(f.dataType, schemas.T.TimestampType)]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _store(w: World) -> jobs.Store:
    store = jobs.Store(f"{new_folder(w)}/store")
    store.prepare(w.spark)
    return store


def _stored_metrics(w: World, store: jobs.Store) -> DataFrame:
    return store.metrics(w.spark).select(
        "event_id", *SERIES, "value", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")
    )


def _unzoned(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query
def stream_dedup(w: World) -> DataFrame:
    store = _store(w)
    twice = _event_stream(w).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    jobs.run_batches(twice, jobs.dedup_batch(store), f"{store.root}-checkpoint").awaitTermination()
    return _stored_metrics(w, store)


@query
def stream_dedup_late(w: World) -> DataFrame:
    """The second half of the month first, then all of it: what comes ten days late is stored once like the rest."""
    store, queue = _store(w), f"{new_folder(w)}/queue"
    half = S.time_literal(w.readings, "timestamp", "2024-01-16 00:00:00")
    events = w.events.withColumn("labels", F.create_map().cast("map<string,string>"))
    for part in (events.where(F.col("timestamp") >= half), events):  # a batch each, of as many files as tasks wrote
        part.write.mode("append").parquet(queue)
        stream = w.spark.readStream.schema(events.schema).parquet(queue)
        jobs.run_batches(stream, jobs.dedup_batch(store), f"{store.root}-checkpoint").awaitTermination()
    return _stored_metrics(w, store)


@query
def stream_rollup_1min(w: World) -> DataFrame:
    store = _store(w)
    jobs.run_batches(_event_stream(w), jobs.rollup_batch(store), f"{store.root}-checkpoint").awaitTermination()
    return rounded_points(_unzoned(jobs.stored_rollup(w.spark, store), "bucket"))


@query
def stream_rollup_fresh(w: World) -> DataFrame:
    """The stored rollup as read in the middle of a minute: only that minute is withheld."""
    store = _store(w)
    jobs.run_batches(_event_stream(w), jobs.rollup_batch(store), f"{store.root}-checkpoint").awaitTermination()
    return rounded_points(_unzoned(jobs.stored_rollup(w.spark, store, "2024-01-20 12:00:30"), "bucket"))


def _refreshed(w: World, of_batch: Column) -> jobs.Store:
    """The readings as batches 0, 1, ... of one stream, each followed by a refresh of the stored rollup."""
    store, queue = _store(w), f"{new_folder(w)}/queue"
    batches = w.readings.withColumn("batch", of_batch)
    each = jobs.rollup_batch(store)
    n = batches.agg(F.max("batch")).first()[0]
    for k in range(n + 1):
        batches.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(queue)
        stream = w.spark.readStream.schema(w.readings.schema).parquet(queue)
        jobs.run_batches(stream, each, f"{store.root}-checkpoint").awaitTermination()
        refreshed_rollup.refresh_rollup(w.spark, store)
    return store


def _late_third(w: World) -> Column:
    """The first half of the month, the second one, then readings of both that came late."""
    half = S.time_literal(w.readings, "timestamp", "2024-01-16 00:00:00")
    return F.when(F.crc32("event_id") % 7 == 0, 2).when(F.col("timestamp") < half, 0).otherwise(1)


@query
def rollup_refresh(w: World) -> DataFrame:
    """The stored rollup after three refreshes, the last one for late readings, and after the replaced files are gone."""
    store = _refreshed(w, _late_third(w))
    refreshed_rollup.expire_rollup(w.spark, store, keep=1)
    return rounded_points(_unzoned(refreshed_rollup.read_rollup(w.spark, store).drop("event_date"), "bucket"))


@query
def series_points_auto_stored(w: World) -> DataFrame:
    """The long route over the stored rollup: the series is read from the days of the range alone."""
    args = ("svc-2", "view", "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    store = _refreshed(w, _late_third(w))
    stored = refreshed_rollup.read_rollup(w.spark, store, *(rollup.as_datetime(a) for a in args[2:]))
    return rounded_points(rollup.series_points_auto(w.readings, _unzoned(stored, "bucket"), *args))


@query
def stream_incidents(w: World) -> DataFrame:
    store = _store(w)
    cuts = w.scored.groupBy(*SERIES).agg(F.min(F.when(F.col("score") < 0, F.col("value"))).alias("floor"))
    hot = _event_stream(w).join(broadcast_if_small(cuts), list(SERIES)).where(F.col("value") >= F.col("floor"))
    jobs.run_batches(hot, jobs.slots_batch(store, GAP), f"{store.root}-checkpoint").awaitTermination()
    return _unzoned(jobs.stored_sessions(w.spark, store, GAP), "started_at", "last_at")


@query
def stream_incident_merge(w: World) -> DataFrame:
    """The anomalies as three batches in no order of time: sessions grow and merge, and members follow their ids."""
    root, queue = f"{new_folder(w)}/store", f"{new_folder(w)}/queue"
    merged_sessions.prepare(w.spark, root)
    for part in range(3):
        w.anomalies.where(S.hash60("anomaly_id") % 3 == part).coalesce(1).write.mode("append").parquet(queue)
    stream = w.spark.readStream.schema(w.anomalies.schema).option("maxFilesPerTrigger", 1).parquet(queue)
    jobs.run_batches(stream, merged_sessions.session_batch(root, GAP), f"{root}-checkpoint").awaitTermination()
    merged_sessions.compact_sessions(w.spark, root)
    members = merged_sessions.session_members(w.spark, root).groupBy("incident_id").agg(F.countDistinct("anomaly_id").alias("n_members"))
    live = merged_sessions.live_sessions(w.spark, root).join(members, "incident_id", "full")
    times = {name: F.timestamp_micros(us).cast("timestamp_ntz") for name, us in (("started_at", "first_us"), ("last_at", "last_us"))}
    return live.withColumns(times).select(*SERIES, *times, F.col("n").alias("n_anomalies"), "n_members")


@query
def stream_suppress(w: World) -> DataFrame:
    """The incidents as three batches in order of time; the last firing of each series is state between them."""
    queue = f"{new_folder(w)}/queue"
    opened = w.opened.select("incident_id", *SERIES, "started_at")
    first, second = (S.time_literal(opened, "started_at", f"2024-01-{d} 00:00:00") for d in (11, 21))
    at = F.col("started_at")
    for part in (at < first, (at >= first) & (at < second), at >= second):
        opened.where(part).coalesce(1).write.mode("append").parquet(queue)
    stream = w.spark.readStream.schema(opened.schema).option("maxFilesPerTrigger", 1).parquet(queue)
    with suppression.keyed_state(w.spark):
        return _finish(w, suppression.stream_suppress(stream, 172_800))


@query
def stream_score(w: World) -> DataFrame:
    """Streamed scoring finds what the batch finds."""
    run = training.train_all(w.readings, AS_OF)
    found = jobs.stream_score(_event_stream(w).drop("labels"), registry.current_models(run.pointers), run.surfaces)
    return _detect_check(w, _finish(w, found), run)


def _ingested(w: World, with_models: bool = False, write=tables.write_metrics_table, indexed: bool = False) -> jobs.Store:
    """Messages written as files, then worked off by the ingest stream into the stored tables."""
    folder = new_folder(w)
    store = jobs.Store(f"{folder}/store")
    w.messages.select(F.col("data").alias("value")).write.text(f"{folder}/queue")
    store.prepare(w.spark)
    if with_models:
        run = training.train_all(w.readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")), AS_OF)
        tables.save_models(run.surfaces.select(schemas.SCORE_SURFACE.names), store.root, "r1")
        tables.save_run(run.pointers.select(schemas.POINTER_EVENT.names), store.root, "model_pointers", "r1")
    messages = jobs.read_metric_stream(w.spark, f"{folder}/queue")
    index = KeyIndex(store.path("metrics_keys")) if indexed else None
    if index:
        index.build(w.spark, store.metrics(w.spark))
    jobs.run_batches(messages, jobs.ingest_batch(store, write, index), f"{folder}/checkpoint").awaitTermination()
    return store


@query
def stream_ingest(w: World) -> DataFrame:
    return _stored_metrics(w, _ingested(w))


@query
def stream_ingest_indexed(w: World) -> DataFrame:
    """The messages through two streams that ask the key index, which is compacted between them: nothing is stored twice."""
    store = _ingested(w, indexed=True)
    index = KeyIndex(store.path("metrics_keys"))
    done = [r["run_id"] for r in store.runs(w.spark, "accounting").select("run_id").distinct().collect()]
    index.compact(store.metrics(w.spark), ["base", *done], "merged")
    again = jobs.read_metric_stream(w.spark, f"{store.root.removesuffix('/store')}/queue")
    jobs.run_batches(again, jobs.ingest_batch(store, index=index), f"{store.root}-second").awaitTermination()
    return _stored_metrics(w, store)


@query
def ingest_torn_write(w: World) -> DataFrame:
    """The storage fails twice, each time with half of the rows written: every event is there once all the same."""
    failures = iter((True, True))

    def torn(rows: DataFrame, path: str) -> None:
        if next(failures, False):
            tables.write_metrics_table(rows.where(F.crc32("event_id") % 2 == 0), path)
            raise OSError("the storage went away")
        tables.write_metrics_table(rows, path)

    store = _ingested(w, write=torn)
    jobs.compact_metrics(w.spark, store, "one")
    return _stored_metrics(w, store)


@query
def stream_queue_source(w: World) -> DataFrame:
    """Messages from a queue in batches of a fourth, broken off once after storing and before acknowledging."""
    folder, breaks = new_folder(w), iter((False, True))
    store = jobs.Store(f"{folder}/store")
    store.prepare(w.spark)
    messages = w.messages.count()
    w.messages.select("data").repartition(max(5, messages // SEGMENT_MESSAGES), "data").write.text(f"{folder}/queue")
    ingest_one = jobs.ingest_batch(store)

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_one(batch, batch_id)
        if next(breaks, False):
            raise RuntimeError("broken off")

    queue, size = f"{folder}/queue", -(-messages // 4)
    try:
        drain_queue(w.spark, queue, each, f"{folder}/checkpoint", size)
    except StreamingQueryException:
        drain_queue(w.spark, queue, each, f"{folder}/checkpoint", size)
    drain_queue(w.spark, queue, each, f"{folder}/other", size)  # without the checkpoint nothing acknowledged comes again
    counts = store.load(w.spark, "accounting").agg(*[F.sum(c).alias(c) for c in ("received", "rejected", "inserted", "skipped")])
    stored = store.metrics(w.spark).agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("event_id").alias("ids"))
    return _figures(counts).unionByName(_figures(stored))


@query
def stream_ingest_restart(w: World) -> DataFrame:
    """The same messages from a second stream with a checkpoint of its own: nothing is replaced, nothing stored twice."""
    store = _ingested(w)
    again = jobs.read_metric_stream(w.spark, f"{store.root.removesuffix('/store')}/queue")
    jobs.run_batches(again, jobs.ingest_batch(store), f"{store.root}-second").awaitTermination()
    counts = store.load(w.spark, "accounting").agg(*[F.sum(c).alias(c) for c in ("received", "rejected", "inserted", "skipped")])
    stored = store.metrics(w.spark).agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("event_id").alias("ids"))
    bad = store.load(w.spark, "quarantine").agg(F.count("data").alias("quarantined"))
    return _figures(counts).unionByName(_figures(stored)).unionByName(_figures(bad))


@query
def insert_first_arrival(w: World) -> DataFrame:
    """Two values under each key, the larger one first: the first arrival is stored, whatever its value."""
    valid, _ = ingest.validate_events(ingest.parse_events(w.messages))
    firsts = ingest.dedupe_first(valid, ["event_id"], ["msg_id"]).drop("labels")
    twice = firsts.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("msg_id") * 2 + F.col("c")).alias("arrival"), "event_id", "timestamp", *SERIES,
        F.when(F.col("c") == 0, F.col("value") + 1000).otherwise(F.col("value")).alias("value"),
    )
    new = ingest.insert_if_absent(twice.select("timestamp", "event_id").limit(0), twice, ["timestamp", "event_id"], ["arrival"])
    return new.select("event_id", r("value"))


@query
def accepted_events(w: World) -> DataFrame:
    request = F.floor(F.col("msg_id") / 40).cast("bigint")
    parsed = ingest.parse_events(w.messages.withColumn("request", request))
    return ingest.accepted_events(parsed, "request").select("request", "msg_id", "event_id", "value")


@query
def dead_letters(w: World) -> DataFrame:
    """A table that cannot be written: every new event is kept with the error and counted."""

    def broken(rows: DataFrame, path: str) -> None:
        raise OSError("no space left")

    store = _ingested(w, write=broken)
    dead = store.load(w.spark, "dead_letters").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("event_id").alias("ids"))
    counts = store.load(w.spark, "accounting").agg(*[F.sum(c).alias(c) for c in ("inserted", "dead_lettered")])
    return _figures(dead).unionByName(_figures(counts))


@query
def stream_late_data(w: World) -> DataFrame:
    """Rollup of a stream whose second batch lies before its first: late readings change their old buckets."""
    store, queue = _store(w), f"{new_folder(w)}/queue"
    half = S.time_literal(w.readings, "timestamp", "2024-01-16 00:00:00")
    for part in (w.readings.where(F.col("timestamp") >= half), w.readings.where(F.col("timestamp") < half)):
        part.coalesce(1).write.mode("append").parquet(queue)
    stream = w.spark.readStream.schema(w.readings.schema).option("maxFilesPerTrigger", 1).parquet(queue)
    jobs.run_batches(stream, jobs.rollup_batch(store), f"{store.root}-checkpoint").awaitTermination()
    return rounded_points(_unzoned(jobs.stored_rollup(w.spark, store), "bucket"))


@query
def stream_model_refresh(w: World) -> DataFrame:
    """Models registered between two batches judge the second one."""
    store, queue = _store(w), f"{new_folder(w)}/queue"
    half = S.time_literal(w.readings, "timestamp", "2024-01-16 00:00:00")
    each, checkpoint = jobs.ingest_batch(store), f"{store.root}-checkpoint"
    seen = []
    for n, (days, as_of) in enumerate(((F.col("timestamp") < half, "2024-01-30 00:00:00"), (F.col("timestamp") >= half, AS_OF))):
        run = training.train_all(w.readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")), as_of, seq=n)
        tables.save_models(run.surfaces.select(schemas.SCORE_SURFACE.names), store.root, f"r{n}")
        tables.save_run(run.pointers.select(schemas.POINTER_EVENT.names), store.root, "model_pointers", f"r{n}")
        rows = w.events.where(days).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(queue)
        jobs.run_batches(jobs.read_metric_stream(w.spark, queue), each, checkpoint).awaitTermination()
        seen.append(run.surfaces.select("model_id", F.lit(n).alias("trained")))
    found = store.load(w.spark, "anomalies").withColumn("half", F.when(F.col("timestamp").cast("timestamp_ntz") < half, 0).otherwise(1))
    return found.join(broadcast_if_small(seen[0].unionByName(seen[1])), "model_id").groupBy("half").agg(
        F.count_if(F.col("trained") != F.col("half")).alias("n_by_other_models"), (F.count(F.lit(1)) > 0).alias("any")
    )


@query
def stream_quarantine(w: World) -> DataFrame:
    store = _ingested(w)
    return store.load(w.spark, "quarantine").groupBy("reason").agg(F.count("data").alias("n"))


@query
def stream_accounting(w: World) -> DataFrame:
    store = _ingested(w)
    sums = [F.sum(c).alias(c) for c in ("received", "rejected", "inserted", "skipped")]
    return store.load(w.spark, "accounting").agg(*sums)


def _cycles(w: World, expire: bool) -> DataFrame:
    store = _ingested(w, with_models=True)
    counts = []
    for n, at in enumerate((AS_OF, "2024-01-31 00:04:59", "2024-01-31 00:05:00")):
        counts.append((n, jobs.run_alert_cycle(w.spark, store, at, f"c{n}")))
        if expire:
            jobs.expire_cycles(w.spark, store)
    series = store.load(w.spark, "anomalies").select(*SERIES).distinct().count()
    made = store.load(w.spark, "incidents").count()
    rows = [
        # Each series fires once at first, not again within the cooldown, and after it as long as groups wait.
        (n, c["created"] == (series if n == 0 else 0) if n < 2 else c["created"] <= series, c["created"] + c["suppressed"] == (total if n else c["created"] + c["suppressed"]))
        for (n, c), total in zip(counts, [0, *(p["suppressed"] for _, p in counts)], strict=False)
    ]
    rows.append((3, made == sum(c["created"] for _, c in counts), True))
    return w.spark.createDataFrame(rows, "cycle int, created_right boolean, waiting_right boolean")


@query
def stream_alert_cycle(w: World) -> DataFrame:
    return _cycles(w, expire=False)


@query
def alert_cycle_compacted(w: World) -> DataFrame:
    """The same where only the state of the two newest cycles is kept."""
    return _cycles(w, expire=True)


# --- the ways taken beyond a size, forced on tables of any size ------------------------------------


def _long(w: World) -> DataFrame:
    return lineitem_readings(w.table("lineitem"))


@query
def quantile_narrowed(w: World) -> DataFrame:
    from pulsegrid.operators.selection import quantile

    cut = quantile(_long(w), SERIES, "value", 0.95, "q", direct_rows=500)
    return cut.select(*SERIES, F.round("q", 4).alias("q"))


@query
def quantile_from_daily(w: World) -> DataFrame:
    """The quantile of each series from sketches stored per day and one scan of the readings."""
    path = new_folder(w)
    daily_sketches.save_daily_sketches(w.readings, path)
    cut = daily_sketches.quantile_from_daily(w.readings, daily_sketches.load_daily_sketches(w.spark, path), 0.95, "q")
    return cut.select(*SERIES, F.round("q", 4).alias("q"))


@query
def chrono_split_narrowed(w: World) -> DataFrame:
    rows = evaluation.chrono_split(_long(w), direct_rows=500)
    return rows.groupBy(*SERIES, "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query
def sample_rows_narrowed(w: World) -> DataFrame:
    return evaluation.sample_rows(w.readings, seed=42, direct_rows=20).select("event_id", "sampled")


@query
def number_rows_spread(w: World) -> DataFrame:
    from pulsegrid.operators.selection import number_rows

    return number_rows(w.readings.select("event_id", *SERIES, "timestamp"), SERIES, ["timestamp", "event_id"], "n").select("event_id", "n")
