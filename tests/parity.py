"""Run registered queries on Spark and their checks in DuckDB, and compare the rows."""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.schemas import TABLES  # noqa: E402
from corpusloom.session import build_session  # noqa: E402


def local_session():
    spark = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(normal(r[i])) for i in order) for r in rows)


def compare(spark, con, name, plan, sql):
    """(ok, message) for one query."""
    start = time.time()
    df = plan
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows, no check, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    note = f"{name}: {len(got)} rows, {took:.1f}s / {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"{note} COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return False, f"{note} vs {len(b)} DIFF\n   spark {only_a}\n   check {only_b}"
    return True, note


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), database(sf)
    plans, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in plans:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t0 = time.time()
            ok, note = compare(spark, con, name, plans[name](spark, sf), checks.get(name))
            note += f" (total {time.time() - t0:.1f}s)"
        except Exception as exc:  # report and go on
            ok, note = False, f"{name}: {type(exc).__name__} {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", note, flush=True)
    print("failures", bad)
