"""Structured Streaming forms of the two online loops.

R01: generator responses arrive as files; each micro-batch is parsed (T01),
reduced to the first arrival per key, stripped of keys already stored and,
where a target is given, capped by the remaining quota; ``foreachBatch`` adds it to a key
store as the commit ``batchId``, and a commit that is listed is not written
again (idempotent).  The key set lives in the stored buckets, not in the
state store, so state does not grow with the data, and a batch reads only the
buckets of its own keys.

R02: running per-worker request statistics as a streaming aggregation in
``complete`` mode; the state store holds one row per worker.

Answer cache: requests with the same key reuse an earlier valid answer.  The
state store holds one time per key with a valid answer, and drops it when it
expires; what every request was (hit or miss) goes to the sink, by micro-batch.

Both use ``trigger(availableNow=True)`` so a run drains its input and stops.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from textlens.operators.triples import TRIPLE_COLS, first_arrivals, parse_triples
from textlens.sources.keystore import KeyStore


def triple_sink(spark: SparkSession, sink_dir: str, order_cols: Sequence[str], n_buckets: int = 64) -> KeyStore:
    """The sink of :func:`stream_triples`: triples and their arrival, by key."""
    schema = ", ".join(["source_concept STRING", "relation_type STRING", "target_concept STRING", "weight DOUBLE",
                        *[f"{c} BIGINT" for c in order_cols]])
    return KeyStore(spark, sink_dir, schema, TRIPLE_COLS[:3], n_buckets)


def stream_triples(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, source_schema: str,
                   raw_col: str, order_cols: Sequence[str], target: int | None = None,
                   files_per_trigger: int = 1, fmt: str = "json", n_buckets: int = 64) -> None:
    """Run the ingestion stream until the available input is consumed.

    Several files may share a micro-batch: inside a batch rows are taken in
    arrival order (``order_cols``), so the result does not depend on
    ``files_per_trigger``.  A micro-batch reads the buckets that its keys fall
    into, and the stored count from the sink's commit list."""
    keep = [c for c in order_cols if c != "line_idx"]
    order = list(order_cols)
    sink = triple_sink(spark, sink_dir, order, n_buckets)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        firsts = first_arrivals(parse_triples(batch, raw_col, keep=keep), order)
        quota = None if target is None else target - sink.count()
        sink.append(firsts, [*order, "weight"], commit=epoch, limit=quota)

    stream = (spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files_per_trigger)
              .format(fmt).load(source_dir))
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_stream_triples(spark: SparkSession, sink_dir: str, order_cols: Sequence[str]) -> DataFrame:
    return triple_sink(spark, sink_dir, order_cols).read()


def stream_request_stats(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, source_schema: str,
                         by: Sequence[str] = ("worker_id",), ok: str = "ok", seconds: str = "seconds",
                         files_per_trigger: int = 2, fmt: str = "parquet") -> None:
    """Running totals per worker; each trigger rewrites the (small) result."""
    stream = (spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files_per_trigger)
              .format(fmt).load(source_dir))
    agg = stream.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~F.col(ok)).alias("failed_requests"),
        F.sum(F.col(seconds).cast("decimal(20,4)")).alias("sum_seconds"),
        F.count(seconds).alias("n_seconds"),
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_request_stats(spark: SparkSession, out_dir: str, by: Sequence[str] = ("worker_id",)) -> DataFrame:
    s = spark.read.parquet(out_dir)
    return s.select(*by, "total_requests", "failed_requests",
                    F.round(F.col("sum_seconds") / F.col("n_seconds"), 2).cast("double").alias("avg_response_sec"),
                    (F.lit(1.0) - F.col("failed_requests") / F.col("total_requests")).alias("success_rate"))


def stream_cached_answers(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, source_schema: str, *,
                          key: Column, id_col: str, ts_col: str, ok_col: str, by: Sequence[str] = ("worker_id",),
                          ttl_seconds: float | None = None, files_per_trigger: int = 2, fmt: str = "parquet") -> None:
    """Whether each request finds its answer in the cache, in order of time.

    A request is a hit if an answer to its key is stored and not older than
    ``ttl_seconds``; else it is a miss, and a valid answer (``ok_col``) is
    stored at its time.  Hits do not renew an answer.  Invalid answers are never stored.
    Each micro-batch writes ``(id, by, hit)`` over its own folder, so a
    replayed one changes nothing.  Requests arrive in the order of ``ts_col``;
    inside a micro-batch they are put in that order, then by id.  With
    ``ttl_seconds`` an answer leaves the state when the stream's time has passed its
    end, and requests older than that time are dropped as late; without, every key with a valid answer stays."""
    rows = (spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source_dir)
            .withWatermark(ts_col, "0 seconds").select(F.sha2(key, 256).alias("_key"), id_col, ts_col, ok_col, *by))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in [id_col, *by]) + ", hit boolean"
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)

    def answer(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if len(rows) > 1:  # most keys have one request, whose cost is that of these calls
            rows = rows.sort_values([ts_col, id_col], ignore_index=True)
        stored = state.get[0] if state.exists else None
        hits = []
        for at, ok in zip(rows[ts_col].to_numpy().astype("datetime64[ms]").astype("int64").tolist(), rows[ok_col].tolist()):
            hit = stored is not None and (ttl is None or at - stored <= ttl)
            if not hit and ok:
                stored = at
            hits.append(hit)
        if stored is not None:
            end = None if ttl is None else stored + ttl + 1
            if end is None:
                state.update((stored,))
            elif end > state.getCurrentWatermarkMs():
                state.update((stored,))
                state.setTimeoutTimestamp(end)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({**{c: rows[c].array for c in (id_col, *by)}, "hit": hits})

    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    answered = rows.groupBy("_key").applyInPandasWithState(answer, out, "stored LONG", "append", timeout)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")

    q = (answered.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_cache_stats(spark: SparkSession, sink_dir: str, by: Sequence[str] = ("worker_id",)) -> DataFrame:
    """Requests, hits and misses per group so far."""
    s = spark.read.parquet(sink_dir)
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
