"""The answer cache as stream state: counts by plain loops, expiry, restarts and replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textlens.session import scratch_dir
from textlens.streaming import streams as ST

DDL = "id BIGINT, worker_id BIGINT, ts TIMESTAMP, key STRING, ok BOOLEAN"
START = datetime(2026, 1, 1)


def brute(rows, ttl):
    stored, out = {}, {}
    for i, w, ts, key, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in stored and (ttl is None or (ts - stored[key]).total_seconds() <= ttl)
        if not hit and ok:
            stored[key] = ts
        a, b = out.get(w, (0, 0))
        out[w] = (a + hit, b + (not hit))
    return {w: (a + b, a, b) for w, (a, b) in out.items()}


def run(spark, root, ttl):
    ST.stream_cached_answers(spark, f"{root}/src", f"{root}/sink", f"{root}/ck", DDL, key=F.col("key"), id_col="id", ts_col="ts",
                             ok_col="ok", ttl_seconds=ttl, files_per_trigger=1)
    return {r.worker_id: (r.requests, r.hits, r.misses) for r in ST.read_cache_stats(spark, f"{root}/sink").collect()}


@pytest.mark.parametrize("ttl", [None, 60])
def test_counts_equal_loops_over_restarts(spark, ttl):
    rnd, root, rows, now = random.Random(4), scratch_dir(spark, "t-cache"), [], START
    for part in range(3):
        new = []
        for i in range(60):
            now += timedelta(seconds=rnd.randint(0, 9))
            new.append((part * 60 + i, rnd.randint(0, 2), now, f"k{rnd.randint(0, 12)}", rnd.random() < 0.6))
        rows += new
        spark.createDataFrame(new, DDL).coalesce(1).write.mode("append").parquet(f"{root}/src")
        assert run(spark, root, ttl) == brute(rows, ttl)
    assert run(spark, root, ttl) == brute(rows, ttl)  # nothing new to read


def test_a_replayed_batch_changes_nothing(spark):
    root = scratch_dir(spark, "t-replay")
    rows = [(i, 0, START + timedelta(seconds=i), "k", True) for i in range(5)]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{root}/src")
    assert run(spark, root, None) == {0: (5, 4, 1)}
    # the same input read again from the start writes the same folders over
    ST.stream_cached_answers(spark, f"{root}/src", f"{root}/sink", f"{root}/other", DDL, key=F.col("key"), id_col="id", ts_col="ts", ok_col="ok", files_per_trigger=1)
    assert run(spark, root, None) == {0: (5, 4, 1)}
