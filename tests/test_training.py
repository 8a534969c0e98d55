import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import BASE, readings

from pulsegrid.functions.forest import average_path, fit_surface, grow_tree, lookup, normal_core
from pulsegrid.operators import evaluation, scoring
from pulsegrid.operators import selection as sel
from pulsegrid.operators.registry import current_models
from pulsegrid.plans import detection, training

AS_OF = "2025-01-31 00:00:00"
NORMAL = np.random.default_rng(0).normal(50, 2, 500)


def two_series(spark, n=200):
    values = np.random.default_rng(1).normal(50, 5, n)
    return readings(spark, values, "a", "cpu").unionByName(readings(spark, values * 3, "b", "cpu"))


def test_average_path():
    assert average_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(10.244, abs=1e-2)


def test_hand_computed_trees():
    leaf = average_path(np.arange(5)).tolist()
    # Two rows: one split, both leaves at depth 1.
    edges, paths = grow_tree([1.0, 3.0], 1, [0.5, 0.5], leaf)
    assert (edges, paths) == ([2.0], [1.0, 1.0])
    # 0 | 1 2 10 is impossible at 0.5: the cut 5 parts 10 off, then 1 parts 0 1 from 2 at depth limit 2.
    edges, paths = grow_tree([0.0, 1.0, 2.0, 10.0], 2, [0.5, 0.5, 0.5, 0.5], leaf)
    assert edges == [1.0, 5.0] and paths == [2 + leaf[2], 2.0, 1.0]
    # Equal rows cannot be split.
    assert grow_tree([4.0, 4.0, 4.0], 2, [0.5] * 3, leaf) == ([], [leaf[3]])


def test_lookup_takes_the_interval_below_an_equal_edge():
    edges, scores = np.array([1.0, 2.0]), np.array([10.0, 20.0, 30.0])
    assert lookup(edges, scores, np.array([0.0, 1.0, 1.5, 2.0, 9.0])).tolist() == [10, 10, 20, 20, 30]


def test_surface_properties():
    edges, scores = fit_surface(NORMAL, 100, 256, 42)
    again = fit_surface(np.random.default_rng(5).permutation(NORMAL), 100, 256, 42)
    assert np.array_equal(edges, again[0]) and np.array_equal(scores, again[1])
    assert len(scores) == len(edges) + 1 and (np.diff(edges) > 0).all()
    offset = np.quantile(lookup(edges, scores, NORMAL), 0.05)
    assert lookup(edges, scores, np.array([50.0]))[0] - offset > 0
    assert lookup(edges, scores, np.array([500.0]))[0] - offset < 0
    assert np.mean(lookup(edges, scores, NORMAL) < offset) == pytest.approx(0.05, abs=0.01)


def test_constant_series_fits():
    edges, scores = fit_surface(np.full(50, 3.0), 100, 256, 42)
    assert len(edges) == 0 and len(scores) == 1


def fitted(spark, df):
    split = training.split_window(df, AS_OF)
    return split, training.fit_models(split, AS_OF)


def test_fit_draws_bounded_rows_per_series(spark, monkeypatch):
    df = readings(spark, np.arange(400.0))
    out = scoring.fit_isolation_forest(df, n_trees=10, max_rows=16).first()
    assert out["n_fit"] == 160
    monkeypatch.setattr(sel, "DIRECT_ROWS", 50)
    narrowed = scoring.fit_isolation_forest(df.repartition(3), n_trees=10, max_rows=16).first()
    assert narrowed["n_fit"] == 160 and narrowed["edges"] == out["edges"]


def test_fit_rejects_bad_input(spark):
    df = readings(spark, [1.0])
    with pytest.raises(ValueError):
        scoring.fit_isolation_forest(df.limit(0))
    with pytest.raises(ValueError):
        scoring.fit_isolation_forest(df.drop("value"))


def test_scores_flag_spikes_and_five_percent(spark):
    df = readings(spark, NORMAL, "a", "cpu")
    split, models = fitted(spark, df)
    probe = readings(spark, [50.0, 500.0], "a", "cpu")
    scored = scoring.score_events(scoring.attach_current_model(probe, models), models)
    by = {r["value"]: r["score"] for r in scored.collect()}
    assert by[50.0] > 0 > by[500.0]
    train = split.train.join(models.select("service", "metric", "model_id"), ["service", "metric"])
    flagged = scoring.score_events(train, models).where("score < 0").count()
    assert flagged == 20  # 5 % of 400


def test_sorted_scoring_equals_broadcast_scoring(spark, monkeypatch):
    df = two_series(spark)
    _, models = fitted(spark, df)
    edge = models.where("service = 'a'").first()["edges"][3]
    events = scoring.attach_current_model(df.unionByName(readings(spark, [edge, -1e9, 1e9], "a", "cpu", start=BASE)), models)
    events = events.dropDuplicates(["event_id", "value"])
    wide = {(r["event_id"], r["value"]): r["score"] for r in scoring.score_events(events, models).collect()}
    monkeypatch.setattr(scoring, "GROUP_ROWS", 30)
    rows = scoring._score_by_sorting(events, models, group_rows=30).collect()
    assert {(r["event_id"], r["value"]): r["score"] for r in rows} == wide
    assert len(rows) == len(wide) == 403


def test_screened_anomalies_equal_scored_ones(spark):
    df = two_series(spark)
    _, models = fitted(spark, df)
    bounds = [e for r in models.collect() for e in (r["edges"][0], r["edges"][-1], r["edges"][len(r["edges"]) // 2])]
    probe = df.unionByName(readings(spark, bounds + [-1e9, 1e9], "a", "cpu", start=BASE)).dropDuplicates(["event_id", "value"])
    events = scoring.attach_current_model(probe, models)
    for threshold in (0.0, -0.05, 0.1, -9.0, 9.0):
        want = scoring.keep_anomalies(scoring.score_events(events, models), threshold)
        got = scoring.score_anomalies(events, models, threshold)
        assert sorted(got.select("event_id", "value", "score").collect()) == sorted(want.select("event_id", "value", "score").collect())


def test_normal_core():
    edges = np.array([1.0, 2.0, 3.0, 4.0])
    assert normal_core(edges, np.array([-1, 1, 1, -1, 1.0]), 0.0) == (1.0, 3.0)
    assert normal_core(edges, np.ones(5), 0.0) == (-np.inf, np.inf)
    assert normal_core(edges, -np.ones(5), 0.0) == (np.inf, -np.inf)


def test_readings_without_model_are_skipped(spark):
    df = two_series(spark)
    _, models = fitted(spark, df.where("service = 'a'"))
    out = scoring.score_events(scoring.attach_current_model(df, models), models)
    assert {r[0] for r in out.select("service").distinct().collect()} == {"a"}


def test_split_is_chronological(spark):
    df = readings(spark, range(101))
    parts = evaluation.chrono_split(df.repartition(5))
    train = parts.where("part = 'train'").agg(F.count("*"), F.max("value")).first()
    assert tuple(train) == (81, 80.0)


def test_gate(spark):
    df = readings(spark, range(9), "few", "m").unionByName(readings(spark, range(10), "enough", "m"))
    assert {r[0] for r in evaluation.min_sample_gate(df).select("service").distinct().collect()} == {"enough"}


def test_injection(spark):
    df = readings(spark, [10.0] * 100)
    out = evaluation.inject_anomalies(df, seed=42)
    hit = out.where("truth = 1").collect()
    assert len(hit) == 5 and all(50.0 <= r["value"] < 100.0 for r in hit)
    assert out.where("truth = 0 and value = 10.0").count() == 95
    assert df.where("value = 10.0").count() == 100
    assert evaluation.inject_anomalies(df.limit(3), 1).where("truth = 1").count() == 1
    assert evaluation.inject_anomalies(df.limit(0), 1).isEmpty()


@pytest.mark.parametrize(
    ("truth", "predicted", "wanted"),
    [
        ([1, 0, 0], [1, 0, 0], (1.0, 1.0, 1.0)), ([1, 1, 0, 0], [0, 0, 1, 1], (0.0, 0.0, 0.0)),
        ([0, 0], [1, 0], (-1.0, -1.0, -1.0)), ([1, 1], [0, 0], (0.0, 0.0, 0.0)), ([1, 1, 0], [1, 0, 1], (0.5, 0.5, 0.5)),
    ],
)
def test_confusion(spark, truth, predicted, wanted):
    rows = [("s", "m", t, p) for t, p in zip(truth, predicted, strict=True)]
    df = spark.createDataFrame(rows, "service string, metric string, truth int, predicted int")
    r = evaluation.confusion_scores(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == wanted


def test_training_run(spark):
    df = two_series(spark).unionByName(readings(spark, range(9), "few", "cpu"))
    run = training.train_all(df, AS_OF)
    rows = {r["service"]: r for r in run.versions.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["n_samples"] == 160
    assert rows["a"]["artifact_path"] == f"models/a/cpu/{rows['a']['model_id']}"
    assert all(0 <= r["eval_f1"] <= 1 for r in rows.values())
    assert sum(r["tp"] + r["fn"] for r in run.evaluation.collect()) == 4
    again = training.train_all(df.repartition(7), AS_OF)
    key = lambda r: {s["model_id"]: (s["edges"], s["offset"]) for s in r.surfaces.collect()}
    assert key(run) == key(again)
    found = detection.detect(readings(spark, [50.0, 999.0], "a", "cpu"), current_models(run.pointers), run.surfaces)
    assert [r["value"] for r in found.collect()] == [999.0]


def test_training_run_without_data(spark):
    run = training.train_all(readings(spark, range(5)), AS_OF)
    assert run.versions.isEmpty() and run.pointers.isEmpty() and run.surfaces.isEmpty()


def test_loading_a_series(spark):
    df = readings(spark, range(10))
    got = [r["value"] for r in evaluation.load_series(df, "s", "m", "2025-01-15 12:02:00", "2025-01-15 12:05:00").collect()]
    assert got == [2.0, 3.0, 4.0]
    assert evaluation.load_series(df, "s", "none", "2025-01-15 00:00:00", AS_OF).isEmpty()
    assert evaluation.discover_pairs(df, "2025-01-16 00:00:00").isEmpty()
