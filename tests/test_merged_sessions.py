"""Stored sessions that late anomalies extend and join: one id goes on, every other one resolves to it."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import anomalies

from pulsegrid.operators import incidents
from pulsegrid.streaming import merged_sessions

GAP = 600


@pytest.fixture
def store(spark, tmp_path):
    """Feeds batches of anomalies given by their seconds, and reads what is stored."""
    root = str(tmp_path)
    merged_sessions.prepare(spark, root)

    class Store:
        each = staticmethod(merged_sessions.session_batch(root, GAP))
        folder = root

        def batch(self, n, seconds, service="s"):
            rows = anomalies(spark, seconds, service, "m", seconds=True)
            # Ids from the time, so that batches do not share them.
            rows = rows.withColumn("anomaly_id", F.concat_ws("-", "service", F.unix_seconds("timestamp")))
            self.each(rows, n)
            return rows

        def live(self):
            rows = merged_sessions.live_sessions(spark, root).collect()
            start = min((r["first_us"] for r in rows), default=0)
            return {(r["service"], (r["first_us"] - start) // 10**6, (r["last_us"] - start) // 10**6): (r["n"], r["incident_id"]) for r in rows}

        def members(self):
            return {r["anomaly_id"]: r["incident_id"] for r in merged_sessions.session_members(spark, root).collect()}

        def resolved(self, *ids):
            rows = spark.createDataFrame([(i,) for i in ids], "incident_id string")
            return [r["incident_id"] for r in merged_sessions.resolve_ids(rows, root).collect()]

    return Store()


def test_a_late_anomaly_joins_two_sessions(store):
    store.batch(0, [0, 100, 1300])
    before = store.live()
    assert {k: v[0] for k, v in before.items()} == {("s", 0, 100): 2, ("s", 1300, 1300): 1}
    store.batch(1, [700])  # as far from both as the gap
    after = store.live()
    assert {k: v[0] for k, v in after.items()} == {("s", 0, 1300): 4}
    (first, second), (kept,) = ([v[1] for _, v in sorted(d.items())] for d in (before, after))
    assert kept == first and store.resolved(first, second, "unknown") == [first, first, "unknown"]
    assert set(store.members().values()) == {first} and len(store.members()) == 4


def test_beyond_the_gap_and_other_series_stay_apart(store):
    store.batch(0, [0])
    store.batch(1, [601])
    store.batch(2, [300], service="t")
    assert {k: v[0] for k, v in store.live().items()} == {("s", 0, 0): 1, ("s", 601, 601): 1, ("t", 300, 300): 1}


def test_an_earlier_start_keeps_the_id(store):
    store.batch(0, [500, 600])
    ((_, name),) = store.live().values()
    store.batch(1, [0])
    assert store.live() == {("s", 0, 600): (3, name)}


def test_ids_merged_again_resolve_in_one_look(store):
    store.batch(0, [0, 1000, 2000, 3000])
    ids = [v[1] for _, v in sorted(store.live().items())]
    store.batch(1, [2500])
    assert store.resolved(*ids) == [ids[0], ids[1], ids[2], ids[2]]
    store.batch(2, [1500])
    assert store.resolved(*ids) == [ids[0], ids[1], ids[1], ids[1]]
    store.batch(3, [500])
    assert store.resolved(*ids) == [ids[0]] * 4
    assert store.live() == {("s", 0, 3000): (7, ids[0])}


def test_a_repeated_batch_replaces_itself_and_an_empty_one_changes_nothing(store):
    store.batch(0, [0, 1000])
    for _ in range(2):
        store.batch(1, [500])
    store.batch(2, [])
    ((n, name),) = store.live().values()
    assert n == 3 and set(store.members().values()) == {name}


def test_compaction_leaves_one_run_and_the_same_state(spark, store):
    assert merged_sessions.compact_sessions(spark, store.folder) == 0
    store.batch(0, [0, 1000, 5000])
    ids = [v[1] for _, v in sorted(store.live().items())]
    store.batch(1, [500])
    live, members = store.live(), store.members()
    assert merged_sessions.compact_sessions(spark, store.folder) == 2
    assert store.live() == live and store.members() == members and store.resolved(*ids) == [ids[0], ids[0], ids[2]]
    assert merged_sessions.compact_sessions(spark, store.folder) == 0
    store.batch(2, [5100])
    assert sorted(v[0] for v in store.live().values()) == [2, 3]


def test_any_order_of_batches_gives_the_batch_sessions(store):
    draw = np.random.default_rng(3)
    seconds = [int(s) for s in draw.choice(40_000, 90, replace=False)]
    parts = None
    for n in range(3):
        rows = store.batch(n, seconds[n::3])
        parts = rows if parts is None else parts.unionByName(rows)
    whole = incidents.group_incidents(parts, GAP).select("n_anomalies", F.unix_micros("started_at").alias("a"), F.unix_micros("last_at").alias("b")).collect()
    start = min(r["a"] for r in whole)
    assert {("s", (r["a"] - start) // 10**6, (r["b"] - start) // 10**6): r["n_anomalies"] for r in whole} == {k: v[0] for k, v in store.live().items()}
    by_id = {v[1]: v[0] for v in store.live().values()}
    found = list(store.members().values())
    assert {i: found.count(i) for i in found} == by_id
