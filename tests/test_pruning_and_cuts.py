"""Exact top-k with pruning (J08), splits by a cut value (M08), scoring each text once."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.operators import prep as P
from textlens.operators import scoring as S
from textlens.operators import vectors as V

KIND = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    out = []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and np.linalg.norm(v) > 0}
    for i in unit:
        if asked(i):
            near = sorted((-round(float(unit[i] @ u), 9), j) for j, u in unit.items() if j != i)[:k]
            out += [(i, n + 1, j, -c) for n, (c, j) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.cosine, 9) + 0.0) for r in df.collect())


@pytest.mark.parametrize("pivots,chunk", [(1, 20_000), (7, 20), (40, 5), (500, 20_000)])
def test_pruned_top_k_is_exact(spark, pivots, chunk):
    rnd = np.random.default_rng(pivots)
    centres = rnd.standard_normal((6, 5))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * rnd.standard_normal(5)]) for i in range(220)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, [0.0] * 5), (2001, None)]  # copies, zero, null
    df = spark.createDataFrame(rows, KIND)
    got = V.top_k_cosine(df, df.where("vec_id % 5 = 0"), 4, n_pivots=pivots, chunk_rows=chunk)
    want = brute(rows, lambda i: i % 5 == 0, 4)
    assert [(a, b, c) for a, b, c, _ in rows_of(got)] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([r[3] for r in rows_of(got)], [r[3] for r in want], atol=2e-9)


def test_clustered_vectors_are_mostly_skipped(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((50, 16))
    rows = [(i, [float(x) for x in centres[i % 50] + 0.05 * rnd.standard_normal(16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, KIND)
    visits: dict = {}
    got = V.top_k_cosine(df, df.where("vec_id % 10 = 0"), 5, n_pivots=200, visits=visits)
    assert [r[:3] for r in rows_of(got)] == [r[:3] for r in brute(rows, lambda i: i % 10 == 0, 5)]
    assert 0 < visits["made"] <= visits["possible"] / 3


def test_top_k_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], KIND)
    assert rows_of(V.top_k_cosine(df, df, 5)) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
    assert V.top_k_cosine(df.limit(0), df, 5).collect() == [] and V.top_k_cosine(df, df.limit(0), 5).collect() == []


@pytest.mark.parametrize("n,fraction,few", [(1, 0.2, 10), (5, 0.2, 1), (997, 0.2, 3), (997, 0.35, 10_000), (10, 0.0, 5), (10, 1.0, 5), (0, 0.2, 5)])
def test_split_by_a_cut_value(spark, n, fraction, few):
    ids = spark.range(n).select((F.col("id") * 7).alias("k"))
    order = sorted((hashlib.md5(f"{7 * i}|42".encode()).hexdigest(), str(7 * i)) for i in range(n))
    k = math.ceil(n * fraction)
    assert P.split_cut(ids, "k", fraction, 42, few) == (order[k - 1] if k else None)


def test_split_moves_no_column_of_the_table(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("a wide text").alias("text")).union(spark.createDataFrame([(None, "x"), (3, "again")], "k long, text string"))
    out = P.exact_split(df, "k", 0.2, 42)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    test = {r.k for r in out.where("split = 'test'").collect()}
    assert len(test) == 100 and None not in test and out.count() == 502
    grouped = P.exact_split(df.withColumn("g", F.col("k") % 3), "k", 0.2, 42, by=["g"])
    sizes = {r.g: r.n for r in grouped.where("split = 'test'").groupBy("g").agg(F.count_distinct("k").alias("n")).collect()}
    assert sizes == {0: 34, 1: 34, 2: 34}


def test_distinct_texts_are_scored_once_and_rows_travel_without_them(spark):
    rows = [(i, None if i % 9 == 0 else f"text {i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def make():
        return lambda texts: [[0.0, float(len(t))] for t in texts]

    plain, once = (S.score_texts(df, make, keep=["doc_id"], dedupe=d) for d in (False, True))
    assert plain.columns == once.columns
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, once.collect()), key=key)
    plan = S.score_texts(df, make, keep=["doc_id"], dedupe=True)._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join"):].split("\n")[1]
    assert "text" not in left.replace("sha2(cast(text", "")
