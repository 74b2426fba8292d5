"""Run registered Spark queries and their DuckDB oracle side by side and compare them the way
the driver does: row count, column names, and an order-insensitive hash of the values.

    python tests/oracle_compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import decimal
import hashlib
import math
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

DRIVER_VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, int):
        return repr(round(float(v), 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return sorted(columns), len(rows), h, lines


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs, oracle = entry.queries(), entry.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols, sn, sh, slines = digest(df.columns, srows)
        except Exception as e:  # report and continue
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:45s} SPARK_ERROR {repr(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in oracle:
            results[name] = ("NO_ORACLE", sn)
            if verbose:
                print(f"{name:45s} rows={sn:<8d} (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(oracle[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
            ocols_s, on, oh, olines = digest(ocols, orows)
        except Exception as e:
            results[name] = ("ORACLE_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:45s} ORACLE_ERROR {repr(e)[:400]}")
            continue
        ok = scols == ocols_s and sn == on and sh == oh
        results[name] = ("OK" if ok else "MISMATCH", sn, on)
        if verbose:
            print(f"{name:45s} {'OK' if ok else 'MISMATCH'} rows={sn}/{on} {ts:.2f}s")
            if not ok:
                if scols != ocols_s:
                    print("   cols spark:", scols, "\n   cols oracle:", ocols_s)
                diff_s = sorted(set(slines) - set(olines))[:3]
                diff_o = sorted(set(olines) - set(slines))[:3]
                print("   spark-only:", diff_s, "\n   oracle-only:", diff_o)
    return results


if __name__ == "__main__":
    from mercato.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(extra={"spark.ui.showConsoleProgress": "false"})
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "NO_ORACLE")}
    print(f"\n{len(res) - len(bad)}/{len(res)} fine; bad: {sorted(bad)}")
