"""Queries for the streaming forms.

Each query stages its input as files under the shared checkpoint folder,
runs the stream with ``availableNow`` until the input is drained, and
returns the sink's content.  R01's result must equal W03, R02's must equal
A11, so they reuse those oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import metrics as M
from textlens.plans import q_metrics, q_triples
from textlens.plans.fixtures import table, view
from textlens.plans.registry import query
from textlens.session import materialize, scratch_dir
from textlens.streaming import streams as ST


def _arrive(df, order_col: str, n: int, dest: str, fmt: str) -> None:
    """Write ``df`` into ``dest`` in ``n`` files, one after the other in
    ``order_col`` order, as the file source takes files by their time."""
    held = materialize(df)
    ends = held.agg(F.min(order_col).alias("a"), F.max(order_col).alias("b")).first()
    if ends.a is None:
        held.write.format(fmt).mode("append").save(dest)
        return
    part = F.least(F.floor((F.col(order_col) - ends.a) * n / (ends.b - ends.a + 1)), F.lit(n - 1))
    for k in range(n):
        held.where(part == k).coalesce(1).write.format(fmt).mode("append").save(dest)


@query("r01_stream_triples", q_triples.W03_ORACLE)
def r01(spark, sf):
    root = scratch_dir(spark, "r01")
    lines = view(spark, sf, "v_triple_lines")
    src = f"{root}/source"
    _arrive(lines.select("batch_id", "line_no", "line"), "batch_id", 5, src, "json")
    ST.stream_triples(spark, src, f"{root}/sink", f"{root}/checkpoint",
                      "batch_id BIGINT, line_no BIGINT, line STRING", "line", q_triples.ORDER,
                      target=q_triples.N_TARGET, files_per_trigger=1, n_buckets=8)
    return ST.read_stream_triples(spark, f"{root}/sink", q_triples.ORDER)


@query("r02_stream_request_stats", q_metrics.A11_ORACLE)
def r02(spark, sf):
    root = scratch_dir(spark, "r02")
    att = view(spark, sf, "v_attempts").select("event_id", "worker_id", "ok", "seconds")
    src = f"{root}/source"
    att.repartitionByRange(10, "event_id").write.parquet(src)
    ST.stream_request_stats(spark, src, f"{root}/out", f"{root}/checkpoint",
                            "event_id BIGINT, worker_id BIGINT, ok BOOLEAN, seconds DOUBLE", files_per_trigger=5)
    s = ST.read_request_stats(spark, f"{root}/out")
    return s.select("worker_id", "total_requests", "failed_requests",
                    F.round("avg_response_sec", 6).alias("avg_response_sec"),
                    F.round("success_rate", 6).alias("success_rate"))


@query("r02_answer_cache", """
WITH r AS (SELECT conv_id % 5 AS worker_id, turn % 3 <> 2 AS ok, substr(text, 1, 150) || '|' || role AS key,
                  conv_id * 1000 + turn AS place FROM conversations),
h AS (SELECT worker_id, coalesce(min(CASE WHEN ok THEN place END) OVER (PARTITION BY key) < place, false) AS hit FROM r)
SELECT worker_id, count(*) AS requests, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses
FROM h GROUP BY worker_id
""")
def r02_cache(spark, sf):
    """Turns as requests, in four files; answers without expiry."""
    root = scratch_dir(spark, "cache")
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), (F.col("conv_id") % 5).alias("worker_id"),
        (F.col("turn") % 3 != 2).alias("ok"), "text", "role")
    _arrive(c.withColumn("ts", F.timestamp_seconds("at")), "at", 4, f"{root}/source", "parquet")
    ST.stream_cached_answers(spark, f"{root}/source", f"{root}/sink", f"{root}/checkpoint",
                             "at BIGINT, worker_id BIGINT, ok BOOLEAN, text STRING, role STRING, ts TIMESTAMP",
                             key=M.cache_key(F.col("text"), F.col("role")), id_col="at", ts_col="ts", ok_col="ok", files_per_trigger=1)
    return ST.read_cache_stats(spark, f"{root}/sink")
