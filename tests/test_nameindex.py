"""The stored n-gram index (J06) and dense ranks of strings."""

import random

import pytest
from pyspark.sql import functions as F

from textlens.operators import entities as E
from textlens.operators import kb as KB
from textlens.plans.prefix import dense_ranks
from textlens.session import scratch_dir


def brute(terms, names):
    return sorted({(t, k, n) for t in terms if t for k, n in names if n is not None and t.lower() in n.lower()})


def found(index, spark, terms):
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    return sorted(map(tuple, index.search(df).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_brute_force_and_one_off_search(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abC dé中") for _ in range(rnd.randint(0, n)))
    names = [(f"Q{i % 50}", text(9) if i % 13 else None) for i in range(160)]
    terms = sorted({text(4) for _ in range(30)} | {"", "zzz", "A", "é中"})
    index = KB.NameIndex(spark, scratch_dir(spark, "t-ni"), n_buckets=8)
    kind = "qid string, name string"
    for part in (names[:50], names[30:90], names[60:]):
        total = index.extend(spark.createDataFrame(part, kind))
    assert total == len({n for n in names if n[1] is not None})
    want = brute(terms, names)
    assert found(index, spark, terms) == want and want
    once = KB.candidate_matches(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, kind))
    assert sorted(map(tuple, once.collect())) == want


def test_a_search_reads_the_buckets_of_its_grams(spark):
    index = KB.NameIndex(spark, scratch_dir(spark, "t-ni"), n_buckets=200)
    names = spark.range(500).select(F.concat(F.lit("Q"), "id").alias("qid"), F.concat(F.lit("name "), F.md5(F.col("id").cast("string"))).alias("name"))
    index.extend(names)
    asked = spark.createDataFrame([("name",)], "gram string")  # one gram of four letters: a single bucket
    assert len(index.postings(asked).inputFiles()) == 1 and len(index.grams.read().inputFiles()) == 200
    grams = spark.createDataFrame([("nam",), ("ame",)], "gram string")
    assert len(index.postings(grams).inputFiles()) <= 2
    assert len(found(index, spark, ["NAME"])) == 500


def test_a_lost_extension_leaves_no_trace(spark):
    index = KB.NameIndex(spark, scratch_dir(spark, "t-ni"), n_buckets=4)
    kind = "qid string, name string"
    index.extend(spark.createDataFrame([("Q1", "sun")], kind))
    # postings written, names not: the next extension takes the same number
    index.grams._write(spark.createDataFrame([("sun", "Q9", "lost sun")], "gram string, key string, name string"), 1, False)
    assert found(index, spark, ["sun"]) == [("sun", "Q1", "sun")]
    index.extend(spark.createDataFrame([("Q2", "sunny"), ("Q1", "sun")], kind))
    assert found(index, spark, ["sun"]) == [("sun", "Q1", "sun"), ("sun", "Q2", "sunny")]
    assert found(index, spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_dense_ranks_of_strings(spark, n):
    rnd = random.Random(n)
    terms = list({"".join(rnd.choice(["a", "b", "é", "中", "\U0001f525", "￿", " "]) for _ in range(rnd.randint(1, 6))) for _ in range(n)})
    df = spark.createDataFrame([(t, 1) for t in terms] + [(t, 2) for t in terms[:5]] + [(None, 3)], "phrase string, x int").repartition(5)
    out = E.numbered_vocab(df)
    got = sorted((r.id, r.term) for r in out.collect())
    assert got == [(i + 1, t) for i, t in enumerate(sorted(terms))]  # Python sorts by code point
    kept = dense_ranks(spark.createDataFrame([(3.5, "c"), (1.0, "a")], "v double, w string"), "v")
    assert sorted(map(tuple, kept.collect())) == [(1.0, "a", 1), (3.5, "c", 2)]
