"""Compare registered queries with their oracle statements.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from scanloom.plans.views import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", f"{v + 0.0:.6f}" if v else "0.000000")
    if isinstance(v, bool) or v is None:
        return ("o", str(v))
    return (type(v).__name__, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str):
    """(ok, note, Spark seconds)."""
    from __spark_entry__ import oracle_sql, queries
    t0 = time.time()
    df = queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(rows)}", took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = canonical(cols, cur.fetchall())
    got_cols, got = canonical(df.columns, rows)
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}", took
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; only spark {[r for r in got if r not in set(want)][:2]}; only oracle {[r for r in want if r not in set(got)][:2]}", took
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{len(diff)} differing, first {diff[0]}", took
    return True, f"{len(got)} rows", took


def main() -> int:
    from __spark_entry__ import queries
    from scanloom.session import local_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or sorted(queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for n in names:
        try:
            ok, note, took = compare(spark, con, folder, n)
        except Exception as e:
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {took:6.2f}s  {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
