"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [name-prefix ...]

Environment: CHECK_DIR (default sf0.01). Values must be equal after sorting columns and rows.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tripspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", v)
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    return (type(v).__name__, str(v))


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got_names, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    want_names, want = table_of([c[0] for c in res.description], res.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        g, w = bad[0]
        cols = [(c, a, b) for c, a, b in zip(got_names, g, w, strict=True) if a != b]
        return len(got), f"{len(bad)} rows differ, first: {cols[:4]} in {g[:6]}"
    return len(got), ""


def main(prefixes):
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    con = connect(folder)
    failed = []
    for name in entry.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the other queries
            rows, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        state = "rows only" if problem is None else ("ok" if problem == "" else "FAIL")
        print(f"{state:9} {name:28} rows={rows:<7} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
