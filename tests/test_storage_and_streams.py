import json
import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from rows import BASE, anomalies, readings

from pulsegrid import schemas
from pulsegrid.operators import incidents, rollup
from pulsegrid.plans import training
from pulsegrid.sources import tables
from pulsegrid.streaming import jobs


def with_labels(df):
    return df.withColumn("labels", F.create_map(F.lit("region"), F.lit("eu")))


def test_metrics_table_prunes_days(spark, tmp_path):
    path = str(tmp_path / "m")
    df = with_labels(readings(spark, range(100), step=3600))
    tables.write_metrics_table(df, path)
    back = tables.read_metrics_table(spark, path)
    assert back.count() == 100
    one = rollup.in_range(back, BASE + timedelta(days=1), BASE + timedelta(days=2)).select("value")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert one.count() == 24


def test_jsonl_round_trip(spark, tmp_path):
    df = with_labels(readings(spark, [1.25, 2.5]))
    tables.write_jsonl(df, str(tmp_path / "j"))
    back = tables.read_jsonl(spark, str(tmp_path / "j"))
    key = lambda d: sorted(map(str, d.select(*df.columns).collect()))
    assert key(back) == key(df)


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    a = anomalies(spark, [0, 1]).select(schemas.ANOMALY.names)
    for _ in range(2):
        tables.save_run(a, root, "anomalies", "r1")
    tables.save_run(a.limit(1), root, "anomalies", "r2")
    assert tables.load_runs(spark, root, "anomalies", schemas.ANOMALY).groupBy("run_id").count().orderBy("run_id").collect() == [
        ("r1", 2), ("r2", 1)
    ]


# --- streams ------------------------------------------------------------------------------------


def event(i, minutes, value=1.0, **kw):
    base = {"event_id": f"e{i}", "service": "s", "metric": "m", "value": value,
            "timestamp": (BASE + timedelta(minutes=minutes)).isoformat()}
    return json.dumps(base | kw)


def drop_files(folder, batches):
    """One file per batch, in order of modification time."""
    os.makedirs(folder, exist_ok=True)
    for n, lines in enumerate(batches):
        path = os.path.join(folder, f"{len(os.listdir(folder)):03d}-{n}.txt")
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        when = time.time() - 1000 + len(os.listdir(folder))
        os.utime(path, (when, when))


def parsed_stream(spark, folder):
    from pulsegrid.operators.ingest import parse_events, validate_events

    stream = jobs.read_metric_stream(spark, folder, max_files=1)
    return validate_events(parse_events(stream))[0].drop("source_file")


def finish(spark, stream, tmp_path, name="out"):
    out, cp = str(tmp_path / name), str(tmp_path / f"{name}-cp")
    jobs.run_to_table(stream, out, cp).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_dedup_across_batches(spark, tmp_path):
    """Nothing is dropped for being late, and the first arrival stays whatever its value."""
    q, store = str(tmp_path / "q"), jobs.Store(str(tmp_path / "store"))
    store.prepare(spark)
    late = [event(n, -600 * n) for n in range(10, 14)]
    drop_files(q, [[event(1, 0, 9.0), event(2, 1), event(1, 0, 2.0)], [event(2, 1, 0.5), event(3, 2)], late, late])
    jobs.run_batches(parsed_stream(spark, q), jobs.dedup_batch(store), str(tmp_path / "cp")).awaitTermination()
    out = store.metrics(spark).collect()
    assert sorted(r["event_id"] for r in out) == ["e1", "e10", "e11", "e12", "e13", "e2", "e3"]
    assert {r["event_id"]: r["value"] for r in out}["e1"] == 9.0


def test_a_second_stream_replaces_nothing(spark, tmp_path, run):
    store = store_with_models(spark, tmp_path, run)
    for n, junk in enumerate(("junk-one", "junk-two")):
        q = str(tmp_path / f"q{n}")
        drop_files(q, [[event(n, n, 999.0), junk]])
        jobs.run_batches(jobs.read_metric_stream(spark, q), jobs.ingest_batch(store), str(tmp_path / f"cp{n}")).awaitTermination()
    assert sorted(r["data"] for r in store.load(spark, "quarantine").collect()) == ["junk-one", "junk-two"]
    assert store.load(spark, "accounting").count() == 2 and store.load(spark, "anomalies").count() == 2
    # Cycles follow their number although the second clock runs behind.
    assert jobs.run_alert_cycle(spark, store, BASE + timedelta(minutes=10), "c1") == {"created": 1, "suppressed": 0}
    assert jobs.run_alert_cycle(spark, store, BASE + timedelta(minutes=9), "c2") == {"created": 0, "suppressed": 0}


def test_unwritable_events_become_dead_letters(spark, tmp_path, run):
    store = store_with_models(spark, tmp_path, run)
    tries = []

    def broken(rows, path):
        tries.append(path)
        raise OSError("no space left")

    batch = spark.createDataFrame([(x, "f") for x in (event(1, 0, 50.0), event(2, 1, 999.0), "junk")], "data string, source_file string")
    jobs.ingest_batch(store, broken)(batch, 0)
    dead = store.load(spark, "dead_letters").collect()
    assert len(tries) == jobs.WRITE_ATTEMPTS and sorted(r["event_id"] for r in dead) == ["e1", "e2"] and "no space left" in dead[0]["error"]
    counts = store.load(spark, "accounting").first()
    assert (counts["received"], counts["rejected"], counts["inserted"], counts["skipped"], counts["dead_lettered"]) == (3, 1, 0, 0, 2)
    assert store.load(spark, "anomalies").count() == 1 and jobs.stored_rollup(spark, store).isEmpty()


def test_stored_rollup_is_fresh_and_keeps_late_readings(spark, tmp_path):
    store = jobs.Store(str(tmp_path / "store"))
    store.prepare(spark)
    each = jobs.rollup_batch(store)
    first = readings(spark, [1.0, 2.0, 3.0, 4.0], step=30)  # two minutes
    each(first, 0)
    each(first, 0)  # a repeated batch replaces itself
    each(readings(spark, [9.0], start=BASE + timedelta(seconds=10)), 1)  # late, into the first minute
    out = {r["bucket"]: (r["avg_value"], r["sample_count"]) for r in jobs.stored_rollup(spark, store).collect()}
    assert sorted(out.values()) == [(3.5, 2), (4.0, 3)]
    at = BASE.replace(tzinfo=None) + timedelta(seconds=90)
    assert jobs.stored_rollup(spark, store, at).count() == 1


def test_streamed_rollup_equals_batch_and_ignores_late_rows(spark, tmp_path):
    q = str(tmp_path / "q")
    first = [event(i, i * 0.25, value=float(i)) for i in range(40)]
    second = [event(100 + i, 10 + i * 0.25, value=float(i)) for i in range(40)]
    late = [event(900, 0.5, value=1e6)]
    flush = [event(999, 100_000)]
    # A batch drops rows behind the watermark its predecessor started with, hence two batches in between.
    drop_files(q, [first, second, flush, [event(998, 100_001)], late, flush])
    out = finish(spark, jobs.stream_rollup_1min(parsed_stream(spark, q)), tmp_path)
    rows = [json.loads(x) for x in first + second]
    df = spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    want = rollup.rollup_1min(df)
    key = lambda d: sorted(tuple(r) for r in d.select("bucket", "avg_value", "min_value", "max_value", "sample_count").collect())
    assert key(out) == key(want)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    q = str(tmp_path / "q")
    minutes = [0, 5, 15, 26, 60, 61, 200]
    drop_files(q, [[event(i, m)] for i, m in enumerate(minutes)] + [[event(99, 100_000)]])
    out = finish(spark, jobs.stream_incidents(parsed_stream(spark, q)), tmp_path)
    batch = incidents.group_incidents(anomalies(spark, minutes))
    key = lambda d: sorted((r["started_at"], r["last_at"], r["n_anomalies"]) for r in d.collect())
    assert key(out) == key(batch)


@pytest.fixture(scope="module")
def run(spark):
    history = readings(spark, [50 + (i % 7) - 3 + (i % 13) / 10 for i in range(300)], start=BASE - timedelta(days=1))
    return training.train_all(history, BASE)


def store_with_models(spark, tmp_path, run):
    store = jobs.Store(str(tmp_path / "store"))
    store.prepare(spark)
    tables.save_models(run.surfaces.select(schemas.SCORE_SURFACE.names), store.root, "r1")
    tables.save_run(run.pointers.select(schemas.POINTER_EVENT.names), store.root, "model_pointers", "r1")
    return store


def ingest(spark, store, q, tmp_path):
    stream = jobs.read_metric_stream(spark, q, max_files=1)
    jobs.run_batches(stream, jobs.ingest_batch(store), str(tmp_path / "cp")).awaitTermination()


def test_ingest_stores_quarantines_scores_and_alerts(spark, tmp_path, run):
    store, q = store_with_models(spark, tmp_path, run), str(tmp_path / "q")
    normal = [event(i, i, 50.0) for i in range(5)]
    drop_files(q, [normal + ["junk"], normal + [event(50, 6, 999.0)], [event(51, -2000, 50.0), event(52, 8, 999.0, service="new")]])
    ingest(spark, store, q, tmp_path)
    assert store.metrics(spark).count() == 8  # five, the spike, the late one and the unknown series
    bad = store.load(spark, "quarantine").collect()
    assert [(r["data"], r["reason"]) for r in bad] == [("junk", "bad json")]
    found = store.load(spark, "anomalies").collect()
    assert [(r["event_id"], r["value"], r["status"]) for r in found] == [("e50", 999.0, "open")]
    counts = {r["batch_id"]: (r["received"], r["rejected"], r["inserted"], r["skipped"]) for r in store.load(spark, "accounting").collect()}
    assert counts == {0: (6, 1, 5, 0), 1: (6, 0, 1, 5), 2: (2, 0, 2, 0)}
    now = BASE + timedelta(minutes=10)
    assert jobs.run_alert_cycle(spark, store, now, "c1") == {"created": 1, "suppressed": 0}
    assert jobs.run_alert_cycle(spark, store, now, "c1") == {"created": 1, "suppressed": 0}  # the same cycle again
    assert store.load(spark, "incidents").count() == 1 and store.load(spark, "incident_members").count() == 1
    drop_files(q, [[event(60, 60, 999.0)]])
    ingest(spark, store, q, tmp_path)
    assert jobs.run_alert_cycle(spark, store, now + timedelta(seconds=299), "c2") == {"created": 0, "suppressed": 1}
    assert jobs.run_alert_cycle(spark, store, now + timedelta(seconds=300), "c3") == {"created": 1, "suppressed": 0}
    assert store.load(spark, "incidents").count() == 2
    # A cycle reads what is left and what is new, never the whole history.
    assert store.runs(spark, "waiting").where("run_id = 'c2'").count() == 1
    assert store.runs(spark, "waiting").where("run_id = 'c3'").isEmpty()
    assert jobs.run_alert_cycle(spark, store, now + timedelta(days=1), "c4") == {"created": 0, "suppressed": 0}


def test_a_cycle_opens_only_what_is_above_the_marks(spark, tmp_path, run):
    store = store_with_models(spark, tmp_path, run)
    each = jobs.ingest_batch(store)
    spike = lambda i: spark.createDataFrame([(event(i, 60 * i, 999.0), "f")], "data string, source_file string")
    seen = []
    for n in range(3):
        each(spike(2 * n), 2 * n)
        each(spike(2 * n + 1), 2 * n + 1)
        marks = {"direct": 2 * n - 1} if n else {}
        upto = jobs.complete_to(spark, store, marks)
        assert upto == {"direct": 2 * n + 1}
        fresh = jobs.taken_anomalies(spark, store, marks, upto)
        assert sorted(r["event_id"] for r in fresh.collect()) == [f"e{2 * n}", f"e{2 * n + 1}"]
        plan = fresh._jdf.queryExecution().sparkPlan()
        ranges = plan.collectLeaves().apply(0).partitionFilters().toString()
        assert plan.collectLeaves().size() == 1
        assert all(f"{sign} {jobs.batch_run('direct', k)}" in ranges for sign, k in ((">=", 2 * n), ("<=", 2 * n + 1)))
        at = BASE + timedelta(days=n)
        for _ in range(1 + (n == 1)):  # the second cycle twice, the second time after the expiry
            seen.append(jobs.run_alert_cycle(spark, store, at, f"c{n}"))
            jobs.expire_cycles(spark, store)
        assert {r["taken_to"] for r in store.runs(spark, "cycle_marks").where(F.col("run_id") == f"c{n}").collect()} == {2 * n + 1}
    # Two spikes an hour apart a cycle, one of which fires; the other waits with what waited before.
    assert [(c["created"], c["suppressed"]) for c in seen] == [(1, 1), (1, 2), (1, 2), (1, 3)]
    assert store.load(spark, "incidents").count() == 3 and store.load(spark, "fired").select("service").distinct().count() == 1
    left = {r["run_id"] for r in store.runs(spark, "cycles").select("run_id").distinct().collect()}
    assert left == {"c1", "c2"}
    with pytest.raises(ValueError):
        jobs.expire_cycles(spark, store, keep=1)


def test_a_replayed_batch_adds_nothing(spark, tmp_path, run):
    store = store_with_models(spark, tmp_path, run)
    lines = [event(1, 0, 50.0), event(2, 1, 999.0), "junk"]
    batch = spark.createDataFrame([(x, "f") for x in lines], "data string, source_file string")
    for _ in range(2):
        jobs.ingest_batch(store)(batch, 7)
    assert store.metrics(spark).count() == 2
    assert store.load(spark, "anomalies").count() == 1
    assert store.load(spark, "quarantine").count() == 1


def test_new_models_are_used_by_the_next_batch(spark, tmp_path, run):
    store = jobs.Store(str(tmp_path / "store"))
    store.prepare(spark)
    one = lambda i: spark.createDataFrame([(event(i, i, 999.0), "f")], "data string, source_file string")
    each = jobs.ingest_batch(store)
    each(one(1), 0)
    assert store.load(spark, "anomalies").isEmpty()
    tables.save_models(run.surfaces.select(schemas.SCORE_SURFACE.names), store.root, "r1")
    tables.save_run(run.pointers.select(schemas.POINTER_EVENT.names), store.root, "model_pointers", "r1")
    each(one(2), 1)
    assert [r["event_id"] for r in store.load(spark, "anomalies").collect()] == ["e2"]


def test_streamed_scoring_emits_anomalies_only(spark, tmp_path, run):
    from pulsegrid.operators.registry import current_models

    q = str(tmp_path / "q")
    drop_files(q, [[event(1, 0, 50.0), event(2, 1, 999.0)]])
    stream = jobs.stream_score(parsed_stream(spark, q), current_models(run.pointers), run.surfaces)
    assert [r["event_id"] for r in finish(spark, stream, tmp_path).collect()] == ["e2"]
