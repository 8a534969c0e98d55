import pytest
from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid import session
from pulsegrid.operators import ingest

GOOD = '{"event_id":"a","service":"s","metric":"m","value":42.5,"timestamp":"2024-01-01T12:00:00Z","labels":{"region":"us"}}'


def parse(spark, *texts):
    return ingest.parse_events(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id int, data string"))


def reasons(spark, *texts):
    return [r["reason"] for r in parse(spark, *texts).orderBy("msg_id").collect()]


def test_good_event(spark):
    row = parse(spark, GOOD).first()
    assert row["reason"] is None
    assert (row["event_id"], row["service"], row["metric"], row["value"]) == ("a", "s", "m", 42.5)
    assert row["labels"] == {"region": "us"}
    assert parse(spark, GOOD).select(F.col("timestamp").cast("timestamp_ntz")).first()[0] == datetime(2024, 1, 1, 12)


def test_rejections(spark):
    got = reasons(
        spark, None, "not-valid-json", '{"service":"s","metric":"m"}', GOOD[:-2], GOOD.replace("42.5", '"x"'),
        GOOD.replace("42.5", "NaN"), GOOD.replace("2024-01-01T12:00:00Z", "noon"),
        GOOD.replace('{"region":"us"}', '"eu"'), "[]", GOOD.replace('"service":"s",', ""),
    )
    assert got == [
        "missing data", "bad json", "missing value", "bad json", "bad value", "bad value", "bad timestamp",
        "bad labels", "bad json", "missing service",
    ]


def test_quoted_number_and_defaults(spark):
    text = '{"service":"s","metric":"m","value":"1.5","timestamp":"2024-01-01T12:00:00"}'
    rows = parse(spark, text, text).collect()
    assert rows[0]["reason"] is None and rows[0]["value"] == 1.5 and rows[0]["labels"] == {}
    # Without an id of its own, a redelivered event keeps the id of its content.
    assert rows[0]["event_id"] == rows[1]["event_id"]


def test_rejected_messages_keep_their_payload(spark):
    valid, rejected = ingest.validate_events(parse(spark, GOOD, "junk"))
    assert valid.count() == 1 and "data" not in valid.columns
    assert rejected.first()["data"] == "junk"


def test_one_bad_event_refuses_the_request(spark):
    df = spark.createDataFrame([(1, GOOD), (1, GOOD), (2, GOOD), (2, "junk")], "request int, data string")
    got = {r["request"]: r["accepted"] for r in ingest.accept_request(ingest.parse_events(df), "request").collect()}
    assert got == {1: True, 2: False}


def test_same_batch_twice_is_stored_once(spark):
    events, _ = ingest.validate_events(parse(spark, *[GOOD.replace('"a"', f'"e{i}"') for i in range(10)]))
    first = ingest.insert_if_absent(events.limit(0), events.unionByName(events), ["timestamp", "event_id"], ["msg_id"])
    assert first.count() == 10
    again = ingest.insert_if_absent(first, events, ["timestamp", "event_id"], ["msg_id"])
    assert again.count() == 0


def test_dedupe_keeps_the_first_of_many_copies(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        (5000 - F.col("id")).alias("arrival"), F.col("id").alias("payload"),
    )
    out = ingest.dedupe_first(df, ["k"], ["arrival"])
    assert out.count() == df.select("k").distinct().count()
    assert out.where("k = 'hot'").first()["payload"] == 4998


def test_copies_are_combined_before_the_shuffle(spark):
    df = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("arrival"))
    plan = ingest.dedupe_first(df, ["k"], ["arrival"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_anomalies_are_inserted_once_per_event(spark):
    from rows import anomalies

    a = anomalies(spark, [0, 1, 2])
    new = ingest.insert_anomalies(a.where("anomaly_id like '%-0'"), a.drop("status").unionByName(a.drop("status")))
    assert sorted(r["anomaly_id"][-1] for r in new.collect()) == ["1", "2"]
    assert {r["status"] for r in new.collect()} == {"open"}


def test_accounting(spark):
    texts = [GOOD.replace('"a"', f'"{c}"') for c in "abcab"] + ["junk"]
    parsed = parse(spark, *texts).withColumn("batch", F.floor(F.col("msg_id") / 3))
    got = {r["batch"]: r for r in ingest.batch_accounting(parsed, parsed.limit(0), "batch").collect()}
    assert (got[0]["inserted"], got[0]["skipped"], got[0]["rejected"]) == (3, 0, 0)
    assert (got[1]["inserted"], got[1]["skipped"], got[1]["rejected"]) == (0, 2, 1)


def test_completeness_counts_absent_series(spark):
    from rows import BASE, readings

    metrics = readings(spark, range(5))
    catalog = spark.createDataFrame([("s", "m"), ("s", "silent")], "service string, metric string")
    end = BASE.replace(minute=5)
    got = {r["metric"]: r for r in ingest.completeness_audit(metrics, catalog, BASE, end, 60).collect()}
    assert (got["m"]["expected"], got["m"]["stored"], got["m"]["complete"]) == (5, 5, True)
    assert (got["silent"]["stored"], got["silent"]["complete"]) == (0, False)


def test_numbered_rows_are_combined_without_a_sort(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.lit("x").alias("payload"))
    out = ingest.dedupe_first(df, ["k"], ["n"], numbered=True)
    assert sorted(r["n"] for r in out.collect()) == list(range(7))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("old", "new", "reason"),
    [
        ('"service": "s"', '"service": 5', "bad service"), ('"service": "s"', '"service": {"a": 1}', "bad service"),
        ('"metric": "m"', '"metric": [1]', "bad metric"), ('"service": "s"', '"service": null', "missing service"),
        ('"value": 1.5', '"value": "Infinity"', "bad value"), ('"value": 1.5', '"value": "-Infinity"', "bad value"),
        ('"value": 1.5', '"value": "NaN"', "bad value"),
    ],
)
def test_wrong_kinds_are_rejected(spark, old, new, reason):
    text = '{"event_id": "a", "service": "s", "metric": "m", "value": 1.5, "timestamp": "2024-01-01T00:00:00Z"}'
    assert old in text
    rows = spark.createDataFrame([(text.replace(old, new),)], "data string")
    assert [r["reason"] for r in ingest.parse_events(rows).collect()] == [reason]


def test_only_whole_requests_pass(spark):
    text = '{{"event_id": "e{}", "service": "s", "metric": "m", "value": 1.5, "timestamp": "2024-01-01T00:00:00Z"}}'
    rows = [(1, text.format(1)), (1, "junk"), (2, text.format(2)), (2, text.format(3))]
    parsed = ingest.parse_events(spark.createDataFrame(rows, "request int, data string"))
    assert sorted(r["event_id"] for r in ingest.accepted_events(parsed, "request").collect()) == ["e2", "e3"]


def test_a_large_batch_is_not_stored_for_its_keys(spark, monkeypatch):
    """Beyond the bound the keys of a batch are no filter worth having: batch and target meet in one join."""

    def stored(df):
        raise AssertionError("a large batch was stored")

    monkeypatch.setattr(session, "cut_lineage", stored)
    batch = spark.range(session.SMALL_ROWS + 10).select(F.col("id").alias("k"), F.col("id").alias("at"))
    new = ingest.insert_if_absent(batch.where("k % 2 = 0"), batch.union(batch), ["k"], ["at"], small_batch=True)
    assert new.agg(F.count("k"), F.countDistinct("k"), F.sum(F.col("k") % 2)).first() == (100_005, 100_005, 100_005)
