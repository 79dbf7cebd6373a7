"""Run registered queries on Spark and their DuckDB twins; compare results.

Mirrors the correctness gate: row count, column names, and an
order-insensitive multiset of rounded values.

    python scripts/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from storelens.plans.registry import ORACLE, QUERIES  # noqa: E402
from storelens.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    if os.environ.get("PLAIN"):
        # a bare session, as an outside caller would build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g").getOrCreate()
    else:
        spark = get_spark("local[8]", shuffle_partitions=8, driver_memory="16g")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            cols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={cols} duck={dcols}")
            bad += 1
            continue
        order = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in order) for r in drows]
        key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
        s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
        if len(srows) != len(drows) or s_sorted != d_sorted:
            diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
            print(f"FAIL {name}: rows spark={len(srows)} duck={len(drows)} first diffs={diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(srows)} rows {ts:.1f}s")
            ok += 1
    print(f"summary ok={ok} bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
