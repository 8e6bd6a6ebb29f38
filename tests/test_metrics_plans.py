"""Metric invariants, the distributed prefix sum, exact split, partition independence."""

import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from textlens.operators import metrics as M
from textlens.operators import prep as P
from textlens.plans.prefix import global_rank, running_sums


def _preds(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y int, p double").withColumn(
        "yhat", (F.col("p") > 0.5).cast("int"))


def test_running_sums_equal_window(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 7).alias("g"), ((F.col("id") * 37) % 101).alias("v"))
    got = running_sums(df, "id", ["v"], by=["g"], buckets=16).select("id", "cum_v")
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("cum_v"))
    assert sorted(got.collect()) == sorted(ref.collect())
    desc = running_sums(df, "id", ["v"], descending=True, inclusive=False, buckets=5).select("id", "cum_v")
    w2 = Window.orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ref2 = df.select("id", F.coalesce(F.sum("v").over(w2), F.lit(0)).alias("cum_v"))
    assert sorted(desc.collect()) == sorted(ref2.collect())


def test_running_sums_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 2), (None, 3), (2.0, 4)], "k double, v int")
    asc = {(r.k, r.v): r.cum_v for r in running_sums(df, "k", ["v"], tie_cols=["v"], buckets=3).collect()}
    assert asc == {(None, 1): 1, (None, 3): 4, (1.0, 2): 6, (2.0, 4): 10}
    desc = {(r.k, r.v): r.cum_v for r in running_sums(df, "k", ["v"], descending=True, tie_cols=["v"],
                                                      buckets=3).collect()}
    assert desc == {(2.0, 4): 4, (1.0, 2): 6, (None, 1): 7, (None, 3): 10}


def test_global_rank(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    r = global_rank(df, "k", buckets=9).collect()
    assert sorted((x.k, x.rank) for x in r) == [(i, i + 1) for i in range(1000)]


def test_auc_matches_spark_ml(spark):
    df = _preds(spark)
    auc = M.roc_auc(df).first().auc
    ml = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", metricName="areaUnderROC").evaluate(
        df.withColumn("y", F.col("y").cast("double")))
    assert 0.0 <= auc <= 1.0 and abs(auc - ml) < 1e-12


def test_confusion_cells_sum_to_n(spark):
    df = _preds(spark)
    cm = M.confusion_matrix(df).collect()
    assert len(cm) == 4 and sum(r.n for r in cm) == 500
    rep = M.classification_report(df.withColumn("task", F.lit("t"))).collect()
    acc = [r for r in rep if r.row == "accuracy"][0]
    assert abs(acc.f1 - M.accuracy_f1(df).first().accuracy) < 1e-12


def test_exact_split_disjoint_complete(spark):
    df = spark.range(0, 1234).withColumnRenamed("id", "doc_id")
    s = P.exact_split(df, "doc_id", 0.2, 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"test": 247, "train": 987}
    again = P.exact_split(df, "doc_id", 0.2, 42)
    assert sorted(s.collect()) == sorted(again.collect())


def test_result_independent_of_partitions(spark):
    from textlens.plans.registry import queries

    sf = "/root/testdata/sf0.001"
    names = ["a05_roc_auc", "a05_roc_curve", "w01_merge_spans", "p15_entity_slots", "w03_first_n_distinct",
             "a15_ingest_progress", "m08_exact_split", "j06_entity_candidates", "j05_concept_neighbours",
             "j09_two_hop_classes", "a10_knowledge_features", "m07_token_attribution"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = {}
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {q: sorted(map(tuple, queries()[q](spark, sf).collect())) for q in names}
        for q in names:
            assert out["1"][q] == out["8"][q], q
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_roc_corners_match_python(spark):
    import numpy as np

    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = sorted((r.threshold, r.fpr, r.tpr) for r in
                 M.roc_curve(df, drop_intermediate=True, include_origin=True).collect())
    thr = sorted({p for _, p in rows}, reverse=True)
    tps = np.cumsum([sum(1 for y, p in rows if p == t and y == 1) for t in thr])
    fps = np.cumsum([sum(1 for y, p in rows if p == t and y == 0) for t in thr])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    want = sorted([(float("inf"), 0.0, 0.0)] + [(thr[i], fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-12 and abs(g[2] - w[2]) < 1e-12
