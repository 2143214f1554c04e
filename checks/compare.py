"""Run registered queries against their SQL in DuckDB: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb

from checks.oracle import Q
from checks.registry import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(Q[name])
    names = [c[0] for c in cursor.description]
    duck_rows = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if spark_rows == duck_rows:
        return None if spark_rows or "nobody" in name else "no rows"
    only_spark = [r for r in spark_rows if r not in set(duck_rows)][:2]
    only_duck = [r for r in duck_rows if r not in set(spark_rows)][:2]
    return f"{len(spark_rows)} / {len(duck_rows)} rows; {sorted(names)}; only spark {only_spark}; only sql {only_duck}"


def main() -> int:
    from tidemark import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    missing = [n for n in QUERIES if n not in Q]
    print(f"{len(wanted) - bad} of {len(wanted)} equal; without SQL: {missing}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
