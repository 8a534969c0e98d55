"""Quantiles from daily sketches are exact, whatever the sketches say, and scan the readings once."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import BASE, readings

from pulsegrid.operators import daily_sketches
from pulsegrid.operators.selection import quantile
from pulsegrid.session import pin_small
from pulsegrid.sources.tables import with_event_date

SERIES = ("service", "metric")


@pytest.fixture(scope="module")
def month(spark, tmp_path_factory):
    """Ten days of several kinds of values, as a stored table."""
    draw = np.random.default_rng(1)
    parts = {
        "normal": draw.normal(0, 1, 30_000), "ties": draw.integers(0, 3, 9_000), "few": [4.0, 1.0, 9.0], "one": [7.0],
        "heavy": np.exp(draw.normal(0, 4, 20_000)), "infinite": [*range(600), float("inf"), float("-inf")],
    }
    rows = None
    for name, values in parts.items():
        part = readings(spark, [], metric=name, step=28)
        at = [(f"{name}-{i}", "s", name, float(v), BASE + timedelta(seconds=28 * i)) for i, v in enumerate(values)]
        part = spark.createDataFrame(at, part.schema)
        rows = part if rows is None else rows.unionByName(part)
    path = str(tmp_path_factory.mktemp("month"))
    rows.withColumn("extra", F.lit(1)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def as_dict(df):
    return {r["metric"]: r["q"] for r in df.collect()}


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_equals_the_exact_quantile(spark, month, q):
    found = daily_sketches.quantile_from_daily(month, daily_sketches.daily_sketches(month), q, "q")
    assert as_dict(found) == pytest.approx(as_dict(quantile(month, SERIES, "value", q, "q")))


def test_stays_exact_where_sketches_fail(spark, month):
    exact = as_dict(quantile(month, SERIES, "value", 0.95, "q"))
    whole = daily_sketches.daily_sketches(month)
    first = whole.where(F.col("event_date") == F.lit(BASE.date()))
    other = whole.withColumn("metric", F.lit("normal"))
    for wrong in (whole.limit(0), first, other):
        assert as_dict(daily_sketches.quantile_from_daily(month, wrong, 0.95, "q")) == pytest.approx(exact)
    assert as_dict(daily_sketches.quantile_from_daily(month, whole, 0.95, "q", direct_rows=20)) == pytest.approx(exact)


def test_null_and_nan_count_nowhere_and_no_rows_give_none(spark, month):
    odd = month.where("metric = 'few'").unionByName(readings(spark, [float("nan")] * 3, metric="few").withColumn("extra", F.lit(1)))
    odd = odd.unionByName(odd.withColumn("value", F.lit(None).cast("double")))
    assert as_dict(daily_sketches.quantile_from_daily(odd, daily_sketches.daily_sketches(odd), 0.5, "q")) == {"few": 4.0}
    empty = month.limit(0)
    assert as_dict(daily_sketches.quantile_from_daily(empty, daily_sketches.daily_sketches(empty), 0.5, "q")) == {}


def test_only_whole_days_are_replaced(spark, month, tmp_path):
    path = str(tmp_path / "k")
    daily_sketches.save_daily_sketches(month, path)
    first = with_event_date(month).where(F.col("event_date") == F.lit(BASE.date())).drop("event_date")
    daily_sketches.save_daily_sketches(first.unionByName(first), path)
    back = daily_sketches.load_daily_sketches(spark, path)
    days = {r["event_date"]: r["n"] for r in back.groupBy("event_date").agg(F.sum("n").alias("n")).collect()}
    assert days[BASE.date()] == 2 * first.count() and sum(days.values()) == month.count() + first.count()


def test_readings_are_scanned_once(spark, month):
    """Every reading passes the tasks once, whatever the number of series."""
    sketches, _ = pin_small(daily_sketches.daily_sketches(month))
    read = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = month.select("service", "metric", "value", "timestamp").mapInArrow(tally, "service string, metric string, value double, timestamp timestamp")
    assert len(as_dict(daily_sketches.quantile_from_daily(counted, sketches, 0.95, "q"))) == 6
    assert read.value == month.count()
