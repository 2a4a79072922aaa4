"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def compare(spark, name, fn, sql, sf_dir, con=None, verbose=True):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sh, sl = digest(scols, srows)
    dh, dl = digest(dcols, drows)
    ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and sh == dh
    if verbose:
        print(f"{'OK ' if ok else 'BAD'} {name:40s} rows {len(srows):>7}/{len(drows):<7} {t1 - t0:6.2f}s")
        if not ok:
            if sorted(scols) != sorted(dcols):
                print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(dcols))
            a, b = set(sl), set(dl)
            for x in list(a - b)[:3]:
                print("   spark-only:", x[:300])
            for x in list(b - a)[:3]:
                print("   duck-only: ", x[:300])
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from ioclens.session import build_local
    spark = build_local(shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for n, fn in qs.items():
        if names and n not in names:
            continue
        if n not in sqls:
            t0 = time.time()
            c = fn(spark, sf_dir).count()
            print(f"--  {n:40s} rows {c:>7} (no oracle) {time.time() - t0:6.2f}s")
            continue
        try:
            if not compare(spark, n, fn, sqls[n], sf_dir, con):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:400]}")
            bad.append(n)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
