"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tools/oracle_check.py [--sf DIR] [name-prefix ...]

Comparison: same column set, same row count, and the same multiset of rows
after sorting columns by name and rendering values canonically (floats to 6
decimals).  Queries without an oracle get a row count only.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from textlens.plans.fixtures import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(r[i]) for i in order) for r in records)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain", action="store_true", help="use a bare SparkSession, as an outside caller would")
    ap.add_argument("--no-ansi", action="store_true", help="run with spark.sql.ansi.enabled=false")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    from textlens.plans.registry import oracles, queries
    from textlens.session import get_session

    if a.plain:
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        spark = get_session()
    if a.no_ansi:
        spark.conf.set("spark.sql.ansi.enabled", "false")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs, ors = queries(), oracles()
    bad = 0
    for name, fn in qs.items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            scols = df.columns
            srecs = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in ors:
            print(f"ROWS {name}: {len(srecs)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            cur = con.execute(ors[name])
            ocols = [d[0] for d in cur.description]
            orecs = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {name}: columns spark={scols} oracle={ocols}")
            bad += 1
            continue
        sr, orr = rows_of(scols, srecs), rows_of(ocols, orecs)
        if sr == orr:
            print(f"OK   {name}: {len(sr)} rows {dt:.1f}s")
        else:
            bad += 1
            ss, os_ = set(sr), set(orr)
            print(f"FAIL {name}: rows spark={len(sr)} oracle={len(orr)}; cols={sorted(scols)}")
            for x in sorted(ss - os_)[:4]:
                print("   spark only :", x[:300])
            for x in sorted(os_ - ss)[:4]:
                print("   oracle only:", x[:300])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
