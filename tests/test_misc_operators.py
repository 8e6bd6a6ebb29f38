"""Smaller operator contracts: validation, allow-lists, checkpoint choice,
union, splits, alignment, multi-task loss, request stats."""

import math

import pytest

from textlens.operators import metrics as M
from textlens.operators import prep as P


def test_validate_required_strict(spark):
    df = spark.createDataFrame([("a", 1), (None, 0)], "text string, label int")
    rep = {r.field: r for r in P.validate_required(df, ["text", "label", "extra"], {"label": "int"}).collect()}
    assert rep["text"].n_null == 1 and rep["label"].type_ok and not rep["extra"].present
    with pytest.raises(ValueError, match="field 'text'"):
        P.validate_required(df, ["text"], strict=True)


def test_relation_filter_table_and_list(spark):
    e = spark.createDataFrame([("a", "causes", "b"), ("a", "likes", "c")], "src string, rel string, dst string")
    allow = spark.createDataFrame([("causes",)], "r string")
    assert [r.rel for r in P.relation_filter(e, allow).collect()] == ["causes"]
    assert [r.rel for r in P.relation_filter(e, ["likes"]).collect()] == ["likes"]


def test_select_checkpoint_direction(spark):
    runs = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.3), (1, 30, 0.3), (2, 5, 0.9)],
                                 "run_id int, step int, eval_loss double")
    low = sorted((r.run_id, r.step, r.rank) for r in M.select_checkpoint(runs, keep=2).collect())
    assert low == [(1, 20, 1), (1, 30, 2), (2, 5, 1)]
    high = sorted((r.run_id, r.step) for r in M.select_checkpoint(runs, greater_is_better=True, keep=1).collect())
    assert high == [(1, 10), (2, 5)]


def test_union_and_split_frames(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    b = spark.createDataFrame([(2, "y", 1)], "doc_id int, text string, label int")
    u = P.union_datasets({"a": a, "b": b})
    assert sorted((r.dataset, r.label) for r in u.collect()) == [("a", None), ("b", 1)]
    docs = spark.range(0, 50).withColumnRenamed("id", "doc_id")
    train, test = P.split_frames(docs, "doc_id", 0.2, 7)
    ids_tr, ids_te = {r.doc_id for r in train.collect()}, {r.doc_id for r in test.collect()}
    assert len(ids_te) == 10 and not ids_tr & ids_te and len(ids_tr | ids_te) == 50


def test_alignment_report(spark):
    src = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    pred = spark.createDataFrame([(1,), (1,), (4,)], "doc_id int")
    r = P.alignment_report(src, pred, "doc_id").first()
    assert (r.n_src_ids, r.n_pred_ids, r.n_matched, r.n_dup_pred, r.n_missing, r.n_orphan_pred) == (3, 2, 1, 1, 2, 1)


def test_multitask_loss_and_request_stats(spark):
    df = spark.createDataFrame([("sarcasm", 1, 0.9), ("sarcasm", 0, 0.0), ("humor", 1, 1.0)], "task string, y int, p double")
    loss = {r.task: r for r in M.multitask_loss(df).collect()}
    want_s = -(math.log(0.9) + math.log(1.0)) / 2
    assert abs(loss["sarcasm"].loss - want_s) < 1e-12 and loss["humor"].loss < 1e-12
    assert abs(loss["total"].loss - (2.0 * want_s + 0.3 * loss["humor"].loss)) < 1e-12
    log = spark.createDataFrame([(1, True, 1.005, "t1|e"), (1, False, 2.0, "t1|e"), (1, True, 0.0, "t2|e")],
                                "worker_id int, ok boolean, seconds double, k string")
    s = M.request_stats(log, key_col="k").first()
    assert (s.total_requests, s.failed_requests, s.cache_size) == (3, 1, 2)
    assert s.avg_response_sec == 1.0 and abs(s.success_rate - 2 / 3) < 1e-12


def test_dispatching_entry_points(spark):
    from textlens.operators import graph as G
    from textlens.operators import scoring as S

    df = spark.createDataFrame([(1, "a quick brown fox")], "id int, text string")
    assert S.token_attribution(df, S.vowel_length_predictor, ["id"], k=2).count() == 2
    assert S.token_attribution(df, S.vowel_length_predictor, ["id"], mode="sampled", n_samples=8, k=2).count() == 2
    nodes = spark.createDataFrame([("n1", "x"), ("n2", "y")], "node string, grp string")
    edges = spark.createDataFrame([("n1", "is_a", "n2")], "start string, relation string, end string")
    assert {r.node for r in G.property_select(nodes, edges, "node", "grp", ["x"]).collect() if not r.hidden} == {"n1"}
    assert {r.node for r in G.property_select(nodes, edges, "edge", "relation", ["is_a"]).collect()
            if not r.hidden} == {"n1", "n2"}


def test_materialize_computes_the_plan_once(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from textlens.session import materialize

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        calls.add(len(s))
        return s

    df = spark.range(0, 1000).select(counted("id").alias("id"))
    out = materialize(df)
    assert out.count() == 1000 and out.count() == 1000
    assert calls.value == 1000  # one evaluation: not again for the checkpoint write nor for later reads
