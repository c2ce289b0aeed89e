"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tools/parity.py [sf_dir] [name ...]

Comparison: same row count, same column names, and equal multisets of rows
after sorting columns by name (floats rounded to 9 places, NaN/None unified).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from mailguard.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    from mailguard.plans.registry import load_all
    reg = load_all()
    con = duck_connect(sf_dir)
    results = {}
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            scols = sdf.columns
            srows = rows_of(scols, [tuple(r) for r in sdf.collect()])
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:2000])
            if verbose:
                print(f"{name}: SPARK ERROR {str(e)[:2000]}")
            continue
        ts = time.time() - t0
        if not q.oracle:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(q.oracle)
            dcols = [d[0] for d in cur.description]
            drows = rows_of(dcols, cur.fetchall())
        except Exception as e:  # noqa: BLE001
            results[name] = ("duck-error", str(e)[:2000])
            if verbose:
                print(f"{name}: DUCK ERROR {str(e)[:2000]}")
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        ok_v = srows == drows
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        results[name] = (status, len(srows), len(drows))
        if verbose:
            print(f"{name}: {status} spark={len(srows)} duck={len(drows)} ({ts:.1f}s)")
            if not ok_cols:
                print("   cols spark", sorted(scols), "\n   cols duck ", sorted(dcols))
            elif not ok_v:
                sset, dset = set(map(repr, srows)), set(map(repr, drows))
                only_s = [r for r in srows if repr(r) not in dset][:3]
                only_d = [r for r in drows if repr(r) not in sset][:3]
                print("   cols", sorted(scols))
                for r in only_s:
                    print("   spark-only", str(r)[:1500])
                for r in only_d:
                    print("   duck-only ", str(r)[:1500])
    return results


if __name__ == "__main__":
    from mailguard.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:]) or None
    spark = build_session("local[8]", 8, conf={"spark.driver.memory": "16g"})
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print(f"{len(res) - len(bad)}/{len(res)} fine; bad: {bad}")
