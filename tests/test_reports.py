from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from rows import BASE, anomalies, no_members, readings

from pulsegrid.operators import overview, registry, rollup, schedule
from pulsegrid.schemas import INCIDENT, SCHEDULE

DAY = datetime(2025, 1, 1)


def versions(spark, n=3, f1=0.7):
    rows = [(f"m{i}", "s", "cpu", "isolation_forest", DAY + timedelta(days=i), 800, f1, f1, f1) for i in range(n)]
    return spark.createDataFrame(
        rows,
        "model_id string, service string, metric string, algorithm string, trained_at timestamp, n_samples bigint, "
        "eval_precision double, eval_recall double, eval_f1 double",
    )


def test_last_registered_is_current_until_rolled_back(spark):
    v = versions(spark)
    p = registry.register(v)
    assert registry.current_models(p).first()["model_id"] == "m2"
    back = registry.rollback_model(v, "s", "cpu", "m0", "2025-01-05 00:00:00", 1)
    p = p.unionByName(back)
    assert [r["model_id"] for r in registry.current_models(p).collect()] == ["m0"]
    flags = {r["model_id"]: r["is_current"] for r in registry.with_current_flag(v, p).collect()}
    assert flags == {"m0": True, "m1": False, "m2": False}


def test_rollback_needs_a_known_version_of_the_series(spark):
    v = versions(spark)
    for args in (("s", "cpu", "m9"), ("s", "memory", "m0")):
        with pytest.raises(ValueError):
            registry.rollback_model(v, *args, "2025-01-05 00:00:00", 1)


def test_registry_reports(spark):
    v = versions(spark).withColumn("eval_f1", F.when(F.col("model_id") == "m1", -1.0).otherwise(F.col("eval_f1")))
    r = registry.with_current_flag(v, registry.register(v))
    assert tuple(registry.registry_audit(r).first()) == (3, 1, 1, 0)
    assert tuple(registry.avg_f1_evaluated(r).first()) == (0.7, 2, True)
    none = registry.avg_f1_evaluated(r.where("eval_f1 < 0")).first()
    assert none["avg_f1"] is None and none["passes"] is False
    assert registry.score_range_audit(r.withColumn("eval_recall", F.lit(1.5))).first()["n_out_of_range"] == 2
    assert [x["model_id"] for x in registry.model_list(r).collect()] == ["m2", "m1", "m0"]
    assert registry.model_list(r, "s", current_only=True).count() == 1
    assert [x["metric"] for x in registry.metrics_for_service(r, "s").collect()] == ["cpu"]


def incidents(spark, n, status="open", service="s"):
    rows = [(f"{service}{status}{i:03d}", service, "cpu", status, BASE + timedelta(minutes=i), None) for i in range(n)]
    return spark.createDataFrame(rows, INCIDENT)


def test_overview_counts_open_incidents_only(spark):
    metrics = readings(spark, [1], "s").unionByName(readings(spark, [1], "quiet"))
    inc = incidents(spark, 2).unionByName(incidents(spark, 5, "resolved"))
    got = {r["service"]: r for r in overview.service_overview(metrics, inc, anomalies(spark, [3], "s")).collect()}
    assert (got["s"]["open_incidents"], got["s"]["health"]) == (2, "degraded")
    assert got["s"]["last_anomaly_at"] == BASE + timedelta(minutes=3)
    assert (got["quiet"]["open_incidents"], got["quiet"]["health"], got["quiet"]["last_anomaly_at"]) == (0, "healthy", None)


def test_feed_pages_and_counts_empty_incidents(spark):
    inc = incidents(spark, 8)
    members = spark.createDataFrame([("a", "sopen007"), ("b", "sopen007"), ("c", "sopen000")], no_members(spark).schema)
    page = overview.incident_feed(inc, members, limit=3, offset=0).collect()
    assert [(r["incident_id"][-1], r["anomaly_count"]) for r in page] == [("7", 2), ("6", 0), ("5", 0)]
    assert [r["incident_id"][-1] for r in overview.incident_feed(inc, members, limit=3, offset=6).collect()] == ["1", "0"]
    for bad in ({"status": "closed"}, {"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            overview.incident_page(inc, **bad)


def test_service_is_filtered_after_the_page_unless_asked(spark):
    early, late = incidents(spark, 5, service="old"), incidents(spark, 60, service="busy")
    late = late.withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    both, none = early.unionByName(late), no_members(spark)
    assert overview.service_open_incidents(both, none, "old").isEmpty()
    assert overview.service_open_incidents(both, none, "old", filter_first=True).count() == 5
    assert overview.recent_open_incidents(both, none).count() == 10


def test_rollup_and_routing(spark):
    m = readings(spark, range(600), step=15)
    r1 = rollup.rollup_1min(m)
    first = r1.orderBy("bucket").first()
    assert (first["avg_value"], first["min_value"], first["max_value"], first["sample_count"]) == (1.5, 0.0, 3.0, 4)
    end = BASE + timedelta(hours=2)
    short = rollup.series_points_auto(m, r1, "s", "m", BASE, end)
    assert short.count() == 480 and short.first()["sample_count"] == 1
    long = rollup.series_points_auto(m, r1, "s", "m", BASE, end + timedelta(seconds=1))
    assert long.count() == 121 and long.first()["sample_count"] == 4
    # Beyond the limit the newest buckets are lost.
    assert rollup.series_points(r1, 100).agg(F.max("bucket")).first()[0] == BASE + timedelta(minutes=99)
    assert rollup.series_points_auto(m, r1, "s", "none", BASE, end).isEmpty()


def test_ranges_and_markers(spark):
    a = anomalies(spark, [0, 1, 2])
    got = rollup.anomaly_markers(a, "payment-api", "cpu_percent", BASE, BASE + timedelta(minutes=2)).collect()
    assert [r["timestamp"] for r in got] == [BASE, BASE + timedelta(minutes=1)]
    m = readings(spark, range(5), step=3600)
    out = rollup.out_of_range_readings(m, BASE + timedelta(hours=2), max_days=0).first()
    assert (out["n_future"], out["n_too_old"], out["n_default_window"], out["n_total"]) == (2, 2, 2, 5)
    with pytest.raises(ValueError):
        rollup.relative_window(m, "2h", BASE)


def test_bucket_annotation_exact_and_aligned(spark):
    points = rollup.rollup_1min(readings(spark, [1, 1], "payment-api", "cpu_percent"))
    off = anomalies(spark, [0, 70], seconds=True)
    exact = rollup.annotate_buckets(points, off).where("anomaly_value is not null")
    aligned = rollup.annotate_buckets(points, off, align=True).where("anomaly_value is not null")
    assert (exact.count(), aligned.count()) == (1, 2)


# --- schedule -----------------------------------------------------------------------------------

START = datetime(2025, 1, 7, 12)


def plan(spark, *rows):
    df = spark.createDataFrame([(i, "s", "m", *r) for i, r in enumerate(rows)], SCHEDULE)
    return schedule.offset_to_window(df, "2025-01-07 00:00:00")


@pytest.mark.parametrize(
    ("kind", "magnitude", "value", "minute", "wanted"),
    [
        ("spike", 5.0, 40.0, 15, 200.0), ("spike", 3.0, 40.0, 0, 120.0), ("dip", 0.8, 100.0, 15, 20.0),
        ("dip", 0.0, 50.0, 15, 50.0), ("level_shift", 30.0, 50.0, 15, 80.0), ("gradual_drift", 20.0, 50.0, 15, 60.0),
        ("gradual_drift", 20.0, 50.0, 0, 50.0), ("spike", 5.0, 40.0, 30, 40.0), ("spike", 5.0, 40.0, -1, 40.0),
    ],
)
def test_perturbation(spark, kind, magnitude, value, minute, wanted):
    windows = plan(spark, (kind, 12.0, 30.0, None, magnitude))
    m = readings(spark, [value], start=START + timedelta(minutes=minute))
    out = schedule.apply_anomaly_schedule(m, windows).first()
    assert out["value"] == pytest.approx(wanted)
    assert out["is_anomalous"] is (0 <= minute < 30)


def test_first_matching_row_wins_and_minutes_win(spark):
    windows = plan(spark, ("spike", 12.0, 30.0, 5.0, 2.0), ("level_shift", 12.0, None, 1.0, 7.0))
    assert [r["duration_seconds"] for r in windows.orderBy("spec_idx").collect()] == [1800.0, 3600.0]
    m = readings(spark, [10.0] * 4, start=START, step=1200)
    out = schedule.apply_anomaly_schedule(m, windows).orderBy("timestamp").collect()
    assert [(r["value"], r["spec_idx"]) for r in out] == [(20.0, 0), (20.0, 0), (17.0, 1), (10.0, None)]
    assert schedule.injected_count(schedule.apply_anomaly_schedule(m, windows)).first()["n_injected"] == 3


def test_missing_duration_is_an_error(spark):
    with pytest.raises(Exception, match="no duration for s/m"):
        plan(spark, ("spike", 12.0, None, None, 2.0)).collect()


def test_truth_scores(spark):
    windows = plan(spark, ("spike", 12.0, 2.0, None, 2.0))
    m = readings(spark, [0, 9, 9, 0], start=START, step=60).withColumn("flag", F.col("value") > 5)
    r = schedule.score_against_truth(m, windows, "flag").first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 0.5)
