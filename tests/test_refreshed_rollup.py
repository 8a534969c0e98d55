"""The stored rollup: each batch counts once at any moment, and only touched days are written and opened."""

from datetime import timedelta
from pathlib import Path

import pytest
from compare import plan
from pyspark.sql import functions as F
from rows import BASE, readings

from pulsegrid.operators import rollup
from pulsegrid.streaming import jobs
from pulsegrid.streaming import refreshed_rollup as R

DAY = timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    made = jobs.Store(str(tmp_path / "store"))
    made.prepare(spark)
    return made


def counts(df):
    """bucket to (average, count)."""
    return {r["bucket"]: (r["avg_value"], r["sample_count"]) for r in df.collect()}


def over_days(spark, n_days, value, offset=0):
    return readings(spark, [value] * n_days, start=BASE + timedelta(seconds=offset), step=86400)


def test_each_batch_counts_once_before_and_after_refreshes(spark, store):
    each, rows = jobs.rollup_batch(store), []
    for n, (value, offset) in enumerate(((1.0, 0), (4.0, 5), (10.0, 6))):
        batch = over_days(spark, 3, value, offset)
        each(batch, n)
        rows.append(batch)
        everything = rows[0]
        for more in rows[1:]:
            everything = everything.unionByName(more)
        expected = counts(rollup.rollup_1min(everything.withColumn("timestamp", F.col("timestamp").cast("timestamp"))))
        assert counts(R.read_rollup(spark, store)) == expected
        assert len(R.refresh_rollup(spark, store)) == 3
        each(batch, n)  # repeated after it was merged
        assert R.refresh_rollup(spark, store) == []
        assert counts(R.read_rollup(spark, store)) == expected


def test_only_touched_days_are_written_and_read(spark, store):
    each = jobs.rollup_batch(store)
    each(over_days(spark, 5, 1.0), 0)
    first = R.refresh_rollup(spark, store)
    before = R.manifest(spark, store).days
    each(over_days(spark, 1, 3.0, 1).unionByName(readings(spark, [5.0], start=BASE + 4 * DAY)), 1)
    assert R.refresh_rollup(spark, store) == [first[0], first[4]]
    after = R.manifest(spark, store).days
    assert [before[d] == after[d] for d in first] == [False, True, True, True, False]
    one = R.read_rollup(spark, store, BASE + DAY, BASE + 2 * DAY)
    assert one.count() == 2
    opened = {f.split("event_date=")[1][:10] for f in one.inputFiles()}
    assert opened == {str(d) for d in first[1:3]}
    whole = R.read_rollup(spark, store)
    assert "Exchange" not in plan(whole) and "HashAggregate" not in plan(whole)
    per_day = [f.rsplit("/", 2)[0] + f.split("event_date=")[1][:10] for f in whole.inputFiles()]
    assert len({p[-10:] for p in per_day}) == len(set(per_day)) == 5  # one attempt a day


def test_a_refresh_that_breaks_off_changes_nothing(spark, store, monkeypatch):
    each = jobs.rollup_batch(store)
    each(over_days(spark, 2, 1.0), 0)
    R.refresh_rollup(spark, store)
    each(over_days(spark, 2, 3.0, 1), 1)
    expected = counts(R.read_rollup(spark, store))

    def broken(rows, root, table, run_id):
        raise OSError("gone before the manifest")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(R, "save_run", broken)
        R.refresh_rollup(spark, store)
    assert counts(R.read_rollup(spark, store)) == expected and set(expected.values()) == {(2.0, 2)}
    assert len(R.refresh_rollup(spark, store)) == 2 and counts(R.read_rollup(spark, store)) == expected


def test_two_refreshes_side_by_side_lose_nothing(spark, store, monkeypatch):
    each = jobs.rollup_batch(store)
    each(over_days(spark, 2, 1.0), 0)
    old = R.manifest(spark, store)
    R.refresh_rollup(spark, store)
    each(over_days(spark, 2, 3.0, 1), 1)
    with monkeypatch.context() as m:  # the second one began from the same state as the first
        m.setattr(R, "manifest", lambda spark, store: old)
        R.refresh_rollup(spark, store)
    assert set(counts(R.read_rollup(spark, store)).values()) == {(2.0, 2)}
    R.refresh_rollup(spark, store)
    assert set(counts(R.read_rollup(spark, store)).values()) == {(2.0, 2)}


def test_expired_files_go_and_rows_stay(spark, store):
    each = jobs.rollup_batch(store)
    assert R.expire_rollup(spark, store) == 0
    for n in range(4):
        each(over_days(spark, 2, float(n), n), n)
        if n < 3:
            R.refresh_rollup(spark, store)
    expected = counts(R.read_rollup(spark, store))
    # Two manifests, two attempts, two parts with their log.
    assert R.expire_rollup(spark, store, keep=1) == 2 + 2 + 3 + 3
    assert counts(R.read_rollup(spark, store)) == expected
    assert len(list(Path(store.path("rollup_days")).glob("attempt=*"))) == 1
    R.refresh_rollup(spark, store)
    assert counts(R.read_rollup(spark, store)) == expected and {n for _, n in expected.values()} == {4}


def test_streams_have_marks_of_their_own(spark, store):
    for n in range(3):
        R.store_part(store, over_days(spark, 1, 1.0, n), "one", n, jobs.batch_run("one", n))
    R.refresh_rollup(spark, store)
    R.store_part(store, over_days(spark, 1, 5.0, 3), "two", 0, jobs.batch_run("two", 0))
    assert set(counts(R.read_rollup(spark, store)).values()) == {(2.0, 4)}
    R.refresh_rollup(spark, store)
    assert R.manifest(spark, store).marks == {"one": 2, "two": 0}


def test_no_batches_and_empty_batches(spark, store):
    assert R.refresh_rollup(spark, store) == [] and R.read_rollup(spark, store).isEmpty()
    jobs.rollup_batch(store)(over_days(spark, 1, 1.0).limit(0), 0)
    assert R.refresh_rollup(spark, store) == [] and R.read_rollup(spark, store).isEmpty()
