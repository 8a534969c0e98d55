"""Many windows in one series: flattened segments against brute force, and the same results as the short way."""

from datetime import timedelta

import numpy as np
from compare import plan
from pyspark.sql import functions as F
from rows import BASE, readings

from pulsegrid.operators import schedule, schedule_index

WINDOW = "spec_idx long, service string, metric string, anomaly_type string, start timestamp, end timestamp, duration_seconds double, magnitude double"


def windows(spark, rows):
    """(spec, from, to) in seconds after the first reading; None is a bound that is not known."""
    at = lambda s: None if s is None else BASE + timedelta(seconds=s)
    return spark.createDataFrame([(k, "s", "m", "level_shift", at(a), at(b), 1.0, float(k)) for k, a, b in rows], WINDOW)


def winners(spark, rows, n, step=1):
    out = schedule_index.apply_schedule_indexed(readings(spark, [0.0] * n, step=step), windows(spark, rows))
    found = {int(r["event_id"].split("-")[-1]): r["spec_idx"] for r in out.collect()}
    assert len(found) == n and out.columns[-3:] == ["base_value", "spec_idx", "is_anomalous"]
    return [found[i] for i in range(n)]


def brute(rows, n, step=1):
    held = lambda t: [k for k, a, b in rows if a is not None and b is not None and a <= t < b]
    return [min(held(i * step), default=None) for i in range(n)]


def test_nested_touching_empty_repeated_and_unbounded_windows(spark):
    rows = [(5, 0, 50), (4, 10, 40), (3, 20, 30), (3, 20, 30), (2, 30, 31), (1, 60, 60), (1, 70, 65), (0, None, 9), (0, 8, None), (7, 90, 95), (6, 95, 100)]
    assert winners(spark, rows, 110) == brute(rows, 110)


def test_random_windows(spark):
    draw = np.random.default_rng(5)
    for _ in range(3):
        start = draw.integers(0, 200, 60)
        rows = [(int(k), int(a), int(a + d)) for k, a, d in zip(draw.permutation(60), start, draw.integers(0, 64, 60), strict=True)]
        assert winners(spark, rows, 260) == brute(rows, 260)


def test_ten_thousand_windows_in_one_series(spark):
    draw = np.random.default_rng(6)
    start, length = draw.integers(0, 1_000_000, 10_000), draw.integers(1, 5_000, 10_000)
    start[:4000] = start[0] + np.arange(4000)  # nested and crowded
    rows = [(n, int(a), int(a + d)) for n, (a, d) in enumerate(zip(start, length, strict=True))]
    best = np.full(2_000, 10_000)
    at = np.arange(2_000) * 500
    for n, a, b in reversed(rows):
        best[(at >= a) & (at < b)] = n
    assert winners(spark, rows, 2_000, step=500) == [None if b == 10_000 else int(b) for b in best]
    segments = schedule_index.flat_segments(windows(spark, rows))
    n = segments.count()
    by_slot, _ = schedule_index.slotted(segments)
    assert n < 20_000 and by_slot.count() <= 3 * n + 1


def test_same_as_the_array_of_windows(spark):
    rows = [(2, 0, 300), (1, 60, 120), (9, 500, 900)]
    base = readings(spark, range(20), step=60).unionByName(readings(spark, range(5), metric="other"))
    base = base.unionByName(readings(spark, [1.0]).withColumn("timestamp", F.lit(None).cast("timestamp"))).withColumn("flag", F.col("value") > 3)
    key = lambda df: sorted(map(str, df.collect()))
    for w in (windows(spark, rows), windows(spark, [])):
        short, indexed = schedule.apply_anomaly_schedule(base, w), schedule_index.apply_schedule_indexed(base, w)
        assert key(indexed) == key(short.select(*indexed.columns))
        assert key(schedule_index.score_against_truth_indexed(base, w, "flag")) == key(schedule.score_against_truth(base, w, "flag"))


def test_no_window_array_in_the_plan(spark):
    out = schedule_index.apply_schedule_indexed(readings(spark, range(9)), windows(spark, [(1, 0, 5), (2, 3, 9)]))
    text = plan(out)
    assert "specs" not in text and "filter(" not in text and "BroadcastNestedLoopJoin" not in text and "BroadcastHashJoin" in text


def test_many_slots_in_a_series(spark, monkeypatch):
    monkeypatch.setattr(schedule_index, "SLOT_BOUNDS", 4)
    draw = np.random.default_rng(7)
    start, length = draw.integers(0, 400, 90), draw.integers(0, 120, 90)
    start[:30], length[80:] = 50, 400  # many begin at one time, some cover nearly all
    rows = [(int(k), int(a), int(a + d)) for k, a, d in zip(draw.integers(0, 9, 90), start, length, strict=True)]
    base, w = readings(spark, [0.0] * 830), windows(spark, rows)
    short, indexed = schedule.apply_anomaly_schedule(base, w), schedule_index.apply_schedule_indexed(base, w)
    assert sorted(map(str, indexed.collect())) == sorted(map(str, short.select(*indexed.columns).collect()))
    held = sorted((r["from_us"], r["to_us"]) for r in schedule_index.flat_segments(w).collect())
    assert all(a < b for a, b in held) and all(b <= a for (_, b), (a, _) in zip(held, held[1:], strict=False))
    specs = w.select(*schedule_index.SERIES, *[F.unix_micros(c).alias(f"{c}_us") for c in ("start", "end")])
    assert len(schedule_index._slot_cuts(specs).first()["cuts"]) > 20


def test_pieces_without_a_change_of_winner_are_one(spark):
    rows = [(0, 0, 2000)] + [(1 + n % 9, 2 * n, 2 * n + 3) for n in range(500)]
    held = schedule_index.flat_segments(windows(spark, rows)).collect()
    assert [(r["to_us"] - r["from_us"], r["spec"]["spec_idx"]) for r in held] == [(2_000_000_000, 0)]
