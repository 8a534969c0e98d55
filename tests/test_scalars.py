import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S


def one(spark, column, **cols):
    df = spark.range(1)
    for name, value in cols.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("n", "wanted"), [(0, "healthy"), (1, "degraded"), (2, "degraded"), (3, "critical"), (10, "critical")]
)
def test_health(spark, n, wanted):
    assert one(spark, S.health_status("n"), n=n) == wanted


@pytest.mark.parametrize(
    ("s", "wanted"), [(-1.0, "not evaluated"), (0.0, "poor"), (0.6, "fair"), (0.79, "fair"), (0.8, "good")]
)
def test_score_tier(spark, s, wanted):
    assert one(spark, S.score_tier("s"), s=s) == wanted


def test_anomaly_is_strict(spark):
    assert one(spark, S.is_anomaly("s", 0.0), s=-0.01) is True
    assert one(spark, S.is_anomaly("s", 0.0), s=0.0) is False


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("2025-01-02T03:04:05", datetime(2025, 1, 2, 3, 4, 5)),
        ("2025-01-02T03:04:05Z", datetime(2025, 1, 2, 3, 4, 5)),
        ("2025-01-02 03:04:05+02:00", datetime(2025, 1, 2, 1, 4, 5)),
        ("2025-01-02T03:04:05.250000+0000", datetime(2025, 1, 2, 3, 4, 5, 250000)),
        ("2025-01-02", datetime(2025, 1, 2)),
        ("2025-13-02", None), ("2025", None), ("soon", None), ("12:30", None), ("", None),
    ],
)
def test_parse_iso(spark, text, wanted):
    assert one(spark, S.parse_iso_utc("t").cast("timestamp_ntz"), t=text) == wanted


def test_event_time_accepts_numbers(spark):
    wanted = datetime(2023, 11, 14, 22, 13, 20)
    assert one(spark, S.parse_event_time("t").cast("timestamp_ntz"), t="1700000000") == wanted
    assert one(spark, S.parse_event_time("t").cast("timestamp_ntz"), t="1700000000000") == wanted


def test_prediction_remap(spark):
    got = [one(spark, S.remap_prediction(S.predict("s")), s=s) for s in (-0.1, 0.0, 0.2)]
    assert got == [1, 0, 0]


def test_ids_repeat_and_differ(spark):
    a = one(spark, S.deterministic_id("x", "p", "q"), p="1", q="2")
    assert a == one(spark, S.deterministic_id("x", "p", "q"), p="1", q="2")
    assert a != one(spark, S.deterministic_id("y", "p", "q"), p="1", q="2")


def test_labels(spark):
    assert one(spark, S.labels_to_map("t"), t='{"region":"eu"}') == {"region": "eu"}
    assert spark.sql("select cast(null as string) t").select(S.labels_to_map("t")).first()[0] == {}
