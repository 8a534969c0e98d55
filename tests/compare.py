"""Run registered queries beside their SQL: ``python tests/compare.py <sf_dir> [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when equal and free of cross joins, else what is wrong."""
    df = query(spark, sf_dir)
    if "CartesianProduct" in plan(df) or "BroadcastNestedLoopJoin" in plan(df):
        return "cross join"
    mine = normal_rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = normal_rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(different)} of {len(mine)} differ, first {different[0]}" if different else ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pulsegrid.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = open_tables(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, query, sqls[name])
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        mark = "ok " if name in sqls else "rows"
        print(f"{'FAIL' if problem else mark} {name} {time.time() - began:.2f}s {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
