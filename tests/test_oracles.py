"""Every registered query beside its SQL on the smallest data; the others must give rows."""

import pytest
from compare import compare, open_tables

from __spark_entry__ import entry, oracle_sql, queries
from pulsegrid.plans.catalog import QUERIES
from pulsegrid.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"history_to_overview"}))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and {r["health"] for r in rows} <= {"healthy", "degraded", "critical"}
