"""Run every registered query and its DuckDB oracle side by side.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema (column names) and value match.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from docket.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        cols = df.columns
        got = df.collect()
        secs = time.time() - t0
        if name not in orc:
            print(f"{name:26s} rows={len(got):7d} (no oracle) {secs:6.1f}s", flush=True)
            continue
        rel = con.sql(orc[name])
        ocols = rel.columns
        exp = rel.fetchall()
        same_cols = sorted(cols) == sorted(ocols)
        same = same_cols and _rows(got, cols) == _rows(exp, ocols)
        bad += not same
        print(f"{name:26s} rows={len(got):7d}/{len(exp):7d} cols={'ok' if same_cols else (cols, ocols)} "
              f"values={'ok' if same else 'MISMATCH'} {secs:6.1f}s", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
