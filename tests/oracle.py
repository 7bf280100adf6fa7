"""Compare each registered query with its SQL in DuckDB.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, float):
        v = 0.0 if v == 0 else v
        return repr(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows_of(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, q) -> tuple[bool, str]:
    t0 = time.time()
    df = q.build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return True, f"rows-only {len(got)} rows, spark {t1 - t0:.1f}s"
    cur = con.execute(q.sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"{len(got)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return False, f"row count {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{info}; {len(bad)} rows differ, e.g.\n   cols  {sorted(cols)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return True, info + (" EMPTY" if not got else "")


def main() -> int:
    from __spark_entry__ import CATALOG
    from tickloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session("oracle"), connect(sf_dir)
    failed = []
    names = [n for n in CATALOG if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    for n in names:
        try:
            ok, msg = compare(spark, con, sf_dir, CATALOG[n])
        except Exception as e:  # report and go on to the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(("ok   " if ok else "FAIL ") + n + ": " + msg, flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
