"""R01 restart semantics: a second run over the same checkpoint adds nothing;
new files continue from the stored keys and stop at the target."""

from pyspark.sql import functions as F

from textlens.session import scratch_dir
from textlens.streaming import streams as ST

SCHEMA = "batch_id BIGINT, line_no BIGINT, line STRING"
ORDER = ["batch_id", "line_no", "line_idx"]


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def _keys(spark, sink):
    return sorted((r.source_concept, r.weight) for r in ST.read_stream_triples(spark, sink, ORDER).collect())


def test_restart_is_idempotent_and_capped(spark):
    root = scratch_dir(spark, "t-r01")
    src, sink, ck = f"{root}/src", f"{root}/sink", f"{root}/ck"
    _write(spark, src, [(0, i, f"alpha{i},causes,beta{i},1.0") for i in range(3)])
    ST.stream_triples(spark, src, sink, ck, SCHEMA, "line", ORDER, target=5)
    first = _keys(spark, sink)
    assert [k for k, _ in first] == ["alpha0", "alpha1", "alpha2"]
    ST.stream_triples(spark, src, sink, ck, SCHEMA, "line", ORDER, target=5)  # nothing new to read
    assert _keys(spark, sink) == first
    # repeats of stored keys are ignored; new keys fill the quota and stop at the target
    _write(spark, src, [(1, 0, "alpha0,causes,beta0,2.0")] + [(1, i, f"gamma{i},causes,delta{i},1.5") for i in range(1, 6)])
    ST.stream_triples(spark, src, sink, ck, SCHEMA, "line", ORDER, target=5)
    final = _keys(spark, sink)
    assert len(final) == 5 and ("alpha0", 1.0) in final and ("gamma1", 1.5) in final and ("gamma3", 1.5) not in final
    assert ST.read_stream_triples(spark, sink, ORDER).where(F.col("source_concept") == "alpha0").count() == 1
