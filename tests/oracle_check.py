"""Run registered Spark jobs and their DuckDB oracles side by side.

Usage: python tests/oracle_check.py [sf_dir] [key-substring ...]
Compares row count, column names and the order-insensitive multiset of
rows (exact values, columns sorted by name), like the driver's gate.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, sf_dir, key, job, sql, con, verbose=True):
    t = time.time()
    sdf = job(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    td = time.time() - t
    res = dict(key=key, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2),
               duck_s=round(td, 2))
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"cols spark-only={set(scols)-set(dcols)} duck-only={set(dcols)-set(scols)}")
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if len(a) != len(b):
        res.update(ok=False, why="rowcount")
        return res
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:2]
        names = sorted(scols)
        why = []
        for x, y in diffs:
            why.append({names[i]: (x[i], y[i]) for i in range(len(names)) if x[i] != y[i]})
        res.update(ok=False, why=str(why)[:600])
        return res
    res.update(ok=True)
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filt = sys.argv[2:]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from transitlake.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    jobs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key, job in jobs.items():
        if filt and not any(f in key for f in filt):
            continue
        try:
            r = check(spark, sf_dir, key, job, sqls.get(key), con)
        except Exception as e:  # noqa: BLE001
            r = dict(key=key, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
