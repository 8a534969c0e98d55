"""The index of stored keys never misses one, spares days without a hit, and survives breaks and compaction."""

import re
from datetime import timedelta

import pytest
from compare import plan
from pyspark.sql import functions as F
from rows import BASE

from pulsegrid import schemas
from pulsegrid.operators.ingest import insert_if_absent, recent_target
from pulsegrid.sources import tables
from pulsegrid.sources.key_index import KeyIndex, insert_indexed
from pulsegrid.streaming import jobs

KEYS, COLUMNS = ["timestamp", "event_id"], "event_id string, timestamp timestamp, value double, arrival long"


def rows(spark, keys):
    """Rows (key, day) in order of arrival."""
    return spark.createDataFrame(
        [(k, BASE + timedelta(days=d) if d is not None else None, float(n), n) for n, (k, d) in enumerate(keys)], COLUMNS
    )


@pytest.fixture
def table(spark, tmp_path):
    """Three days of a stored table with its index."""
    path = str(tmp_path / "m")
    stored = rows(spark, [(f"e{n}", n % 3) for n in range(300)]).drop("arrival")
    tables.write_metrics_table(stored.withColumns({"service": F.lit("s"), "metric": F.lit("m")}), path)
    read = tables.read_metrics_table(spark, path, schemas.T.StructType([*stored.schema.fields, *schemas.T.StructType.fromDDL("service string, metric string").fields]))
    index = KeyIndex(str(tmp_path / "k"))
    index.build(spark, read)
    return read, index


def found(df):
    return sorted(map(str, df.collect()))


def days_opened(df):
    """Days named by the partition filters of the scans."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(df))
    return {day for text in filters for day in re.findall(r"\d{4}-\d\d-\d\d", text)}


def test_no_key_is_missed_and_few_are_mistaken(spark, tmp_path):
    index = KeyIndex(str(tmp_path / "k"))
    index.build(spark, rows(spark, []))
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("event_id"), (F.lit(BASE) + F.make_dt_interval(days=(F.col("id") % 2).cast("int"))).alias("timestamp"))
    for part in range(2):
        index.add(keys.where(F.crc32("event_id") % 2 == part), f"p{part}")
    assert index.maybe_stored(keys).count() == 40_000
    others = keys.withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    assert index.maybe_stored(others).count() < 400
    elsewhere = keys.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 9 DAYS"))
    assert index.maybe_stored(elsewhere).count() == 0


def test_days_without_a_hit_are_not_opened(spark, table):
    stored, index = table
    fresh = insert_indexed(stored, index, rows(spark, [("new0", 0), ("new1", 1), ("new1", 1)]), KEYS, ["arrival"])
    assert "Scan parquet" not in plan(fresh) and found(fresh.select("event_id", "arrival")) == found(spark.createDataFrame([("new0", 0), ("new1", 1)], "event_id string, arrival long"))
    one = insert_indexed(stored, index, rows(spark, [("new0", 0), ("e1", 1), ("new2", 2)]), KEYS, ["arrival"])
    assert days_opened(one) == {str((BASE + timedelta(days=1)).date())}
    assert sorted(r["event_id"] for r in one.collect()) == ["new0", "new2"]


def test_equals_the_plain_insert(spark, table):
    stored, index = table
    batch = rows(spark, [
        ("e0", 0), ("e0", 1), ("e1", 1), ("n", 0), ("n", 0), ("n", 2), (None, 1), (None, 1), ("e2", None), ("n", 77), ("", 1),
    ]).withColumn("event_date", F.lit("own column"))
    plain = insert_if_absent(recent_target(stored, batch), batch, KEYS, ["arrival"])
    indexed = insert_indexed(stored, index, batch, KEYS, ["arrival"])
    assert indexed.columns == batch.columns and found(indexed) == found(plain.select(*batch.columns))
    assert insert_indexed(stored, index, batch.limit(0), KEYS, ["arrival"]).count() == 0


def test_without_a_whole_index_everything_is_looked_at(spark, table, tmp_path):
    stored, _ = table
    batch = rows(spark, [("e0", 0), ("n", 0)])
    broken = KeyIndex(str(tmp_path / "other"))
    assert [r["event_id"] for r in insert_indexed(stored, broken, batch, KEYS, ["arrival"]).collect()] == ["n"]
    tables.ensure_table(spark, f"{broken.path}/parts/run_id=none", spark.read.parquet(f"{table[1].path}/parts").drop("run_id").schema)
    assert broken.maybe_stored(batch) is None


def test_keys_of_rows_that_never_came_cost_only_a_look(spark, table):
    stored, index = table
    batch = rows(spark, [("lost", 1)])
    index.add(batch, "broken-off")
    again = insert_indexed(stored, index, batch, KEYS, ["arrival"])
    assert [r["event_id"] for r in again.collect()] == ["lost"]


def test_compaction_leaves_one_filter_a_day(spark, table):
    stored, index = table
    index.add(stored.where("event_id < 'e2'"), "p1")
    index.add(rows(spark, [("under way", 1)]), "p2")
    assert index.compact(stored, ["base", "p1"], "merged") == 2
    parts = index.parts(spark)
    assert sorted(r["part"] for r in parts.select("part").distinct().collect()) == ["merged", "p2"]
    assert parts.where("part = 'merged'").count() == 3
    assert index.maybe_stored(stored).count() == 300
    assert index.maybe_stored(rows(spark, [("under way", 1)])).count() == 1
    assert index.compact(stored, ["merged"], "again") == 1 and index.parts(spark).where("part = 'again'").isEmpty()


def test_a_batch_that_fails_to_publish_is_not_lost(spark, tmp_path):
    """Its keys are in the index, its rows are not: the repeated messages are stored by the next stream."""
    store, queue = jobs.Store(str(tmp_path / "store")), tmp_path / "queue"
    store.prepare(spark)
    index = KeyIndex(store.path("metrics_keys"))
    index.build(spark, store.metrics(spark))
    queue.mkdir()
    line = '{"event_id": "e%d", "service": "s", "metric": "m", "value": 1.0, "timestamp": "2025-01-15T12:00:00"}\n'
    (queue / "a.txt").write_text("".join(line % n for n in range(5)))

    def broken(rows, path):
        raise OSError("no space left")

    for n, each in enumerate((jobs.ingest_batch(store, broken, index), jobs.ingest_batch(store, index=index), jobs.ingest_batch(store, index=index))):
        jobs.run_batches(jobs.read_metric_stream(spark, str(queue)), each, str(tmp_path / f"c{n}")).awaitTermination()
        assert store.metrics(spark).count() == (5 if n else 0)
