"""Run registered queries on Spark and their DuckDB oracles; compare results.

usage: python scripts/check_oracle.py [--sf DIR] [key ...]
Prints one line per key: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vigil.plans import load_all  # noqa: E402
from vigil.session import get_spark  # noqa: E402
from vigil.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    queries, oracle = load_all()
    keys = a.keys or sorted(queries)
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = queries[k](spark, a.sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
            ts = time.time() - t0
            if k not in oracle:
                print(f"ROWS  {k}: spark={len(srows)} ({ts:.1f}s) [no oracle]")
                continue
            res = con.execute(oracle[k])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            if sorted(scols) != sorted(dcols):
                bad += 1
                print(f"COLS  {k}: spark={sorted(scols)} duck={sorted(dcols)}")
                continue
            s, d = rows_of(scols, srows), rows_of(dcols, drows)
            if s == d:
                print(f"OK    {k}: rows={len(s)} ({ts:.1f}s)")
            else:
                bad += 1
                ss, dd = set(s), set(d)
                print(f"DIFF  {k}: spark={len(s)} duck={len(d)} only_spark={len(ss - dd)} only_duck={len(dd - ss)}")
                print("   cols:", sorted(scols))
                for r in list(ss - dd)[:3]:
                    print("   S:", r)
                for r in list(dd - ss)[:3]:
                    print("   D:", r)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {k}: {type(e).__name__}: {str(e)[:600]}")
            if a.show:
                traceback.print_exc()
    print(f"done: {len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
