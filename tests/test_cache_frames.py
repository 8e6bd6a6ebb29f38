"""Requests of the answer cache whose key comes once, several times, or out of order."""

from pyspark.sql import functions as F

from textlens.streaming import streams as ST


def test_single_and_repeated_requests(spark, tmp_path):
    rows = spark.createDataFrame([(4, 0, True, "a"), (1, 0, False, "a"), (2, 1, True, "a"), (3, 0, True, "b"), (5, None, None, "c")],
                                 "at long, worker_id long, ok boolean, text string")
    rows.withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/src")
    ST.stream_cached_answers(spark, f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ck",
                             "at long, worker_id long, ok boolean, text string, ts timestamp",
                             key=F.col("text"), id_col="at", ts_col="ts", ok_col="ok")
    got = {r["at"]: (r.worker_id, r.hit) for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (0, False), 4: (0, True), 5: (None, False)}
