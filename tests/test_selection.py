import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import selection as sel

KEYS = ["service"]


@pytest.fixture
def narrow(monkeypatch):
    """Force the narrowing passes on small data."""
    monkeypatch.setattr(sel, "DIRECT_ROWS", 20)
    monkeypatch.setattr(sel, "CUT_POINTS", 8)


def table(spark, groups):
    rows = [(g, f"{g}{i}", float(v), i) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "service string, id string, v double, i bigint").repartition(4)


def samples():
    rnd = random.Random(3)
    return {
        "hot": [rnd.expovariate(0.02) for _ in range(3000)],
        "ties": [float(rnd.randint(0, 4)) for _ in range(700)],
        "same": [7.0] * 400,
        "wide": [rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 12) for _ in range(500)],
        "tiny": [3.0, -1.0],
    }


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_narrowed_quantile_is_exact(spark, narrow, q):
    groups = samples()
    got = {r["service"]: r["q"] for r in sel.quantile(table(spark, groups), KEYS, "v", q, "q").collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_both_quantile_paths_agree(spark, monkeypatch):
    df = table(spark, samples())
    direct = sorted((r["service"], round(r["q"], 9)) for r in sel.quantile(df, KEYS, "v", 0.3, "q").collect())
    monkeypatch.setattr(sel, "DIRECT_ROWS", 10)
    monkeypatch.setattr(sel, "CUT_POINTS", 4)
    narrowed = sorted((r["service"], round(r["q"], 9)) for r in sel.quantile(df, KEYS, "v", 0.3, "q").collect())
    assert direct == narrowed


def test_select_ranks_counts_below_and_equal(spark, narrow):
    groups = samples()
    got = sel.select_ranks(table(spark, groups), KEYS, "v", lambda n: [F.ceil(n * 0.4), n]).collect()
    assert len(got) == 2 * len(groups)
    for r in got:
        values = sorted(groups[r["service"]])
        assert r["value"] == values[r["rank"] - 1]
        assert r["n_below"] == sum(v < r["value"] for v in values)
        assert r["n_equal"] == sum(v == r["value"] for v in values)


@pytest.mark.parametrize("forced", [True, False])
def test_first_k_with_heavy_ties(spark, monkeypatch, forced):
    if forced:
        monkeypatch.setattr(sel, "DIRECT_ROWS", 20)
        monkeypatch.setattr(sel, "CUT_POINTS", 8)
    groups = samples()
    df = table(spark, groups)
    got = sel.mark_first_k(df, KEYS, ["v", "i"], lambda n: F.ceil(n * 0.37), "first").where("first").collect()
    picked = {(r["service"], r["i"]) for r in got}
    for g, values in groups.items():
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        assert {i for s, i in picked if s == g} == set(order[: int(np.ceil(len(values) * 0.37))])


def test_first_k_all_rows(spark, narrow):
    df = table(spark, samples())
    assert sel.mark_first_k(df, KEYS, ["v", "i"], lambda n: n, "first").where("not first").isEmpty()


def test_given_sizes_limit_the_groups(spark):
    df = table(spark, samples())
    sizes = sel.GroupSizes.of(df, KEYS).at_least(500)
    out = sel.mark_first_k(df, KEYS, ["v", "i"], lambda n: F.lit(10), "first", sizes)
    assert {r[0] for r in out.select("service").distinct().collect()} == {"hot", "ties", "wide"}
    assert out.where("first").count() == 30


def test_weighted_quantile(spark):
    values = samples()["ties"]
    counted = table(spark, {"g": values}).groupBy("service", "v").agg(F.count(F.lit(1)).alias("c"))
    for q in (0.05, 0.333, 0.9):
        got = sel.weighted_quantile(counted, KEYS, "v", "c", q, "q").first()["q"]
        assert got == pytest.approx(np.quantile(values, q))


def test_number_rows_spreads_a_hot_group(spark):
    groups = samples()
    out = sel.number_rows(table(spark, groups), KEYS, ["v", "i"], "no")
    for g, values in groups.items():
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        rows = {r["no"]: r["i"] for r in out.where(F.col("service") == g).collect()}
        assert [rows[n + 1] for n in range(len(values))] == order


def test_small_table_check(spark):
    df = spark.range(50)
    from pulsegrid.session import pin_small

    assert pin_small(df, 50)[1].num_rows == 50
    big, rows = pin_small(df, 49)
    assert rows is None and big.count() == 50


def test_later_order_columns_are_computed_for_ties_alone(spark):
    """A thousand rows in ten runs of equal values: the second column is asked for the run that holds the cut, no other."""
    df = spark.range(1000, numPartitions=4).select(F.lit("a").alias("service"), (F.col("id") % 10).alias("v"), F.col("id").alias("i"))
    # Rows outside that run would fail the query.
    second = F.when(F.col("v") != 3, F.raise_error(F.lit("not tied")).cast("bigint")).otherwise(F.col("i"))
    got = sel.mark_first_k(df, KEYS, [F.col("v"), second], lambda n: F.lit(350), "first", direct_rows=20).collect()
    want = sorted(range(1000), key=lambda i: (i % 10, i))[:350]
    assert sorted(r["i"] for r in got if r["first"]) == sorted(want)
