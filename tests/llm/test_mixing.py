import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textlens.llm import mixing
from textlens.llm.queries import op5_mix_sources

from .helpers import SF, no_documents, odd_documents, same_as_sql, words


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Resharing round by round, exactly; None is the last source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in capped]
        left, wsum = total - sum(capped.values()), sum(w[s] for s in rest)
        share = {s: left * w[s] / wsum for s in rest}
        over = {s: Fraction(cap * sizes[s]) for s in rest if share[s] > cap * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_matches_sql(spark):
    same_as_sql(op5_mix_sources(spark, SF), mixing.ORACLE)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_bounds(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", "Z", "a", "é", "\U0001f525", *[f"s{i}" for i in range(6)]]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, rnd.randint(1, 400)])), rnd.choice(sources[:rnd.randint(2, 12)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan_mix(df, carry=("source",)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    assert len(out) == len(rows)
    for r in out:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(target[r.source])) and r.taken == r.copies * r.size
        rate = float(target[r.source]) / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - float(target[s])) <= 2 * largest[s]


def test_hot_source_and_partitioning(spark):
    rows = [(i, "a b c " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.plan_mix(df.repartition(7)).collect()))
    assert one == sorted(map(tuple, mixing.plan_mix(df.repartition(2, "source")).collect()))


def test_odd_documents(spark):
    extra = ["copies", "Target", "_llm_size", "rank"]
    docs = odd_documents(spark, extra)
    plan = mixing.plan_mix(docs).collect()
    assert sorted(r.size for r in plan) == sorted(len(words(r.text)) for r in docs.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    # the copies of a row are that row
    rows = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= rows and len(got) == sum(r.copies for r in plan)
    assert mixing.plan_mix(no_documents(spark)).collect() == [] and mixing.mix(no_documents(spark)).collect() == []


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.copies, r.taken) for r in mixing.plan_mix(df).collect()] == [(0.0, 0, 0)] * 3


@pytest.mark.parametrize("cell_rows", [1, 7, 100])
def test_cells_are_cut_as_their_counts_ask(spark, cell_rows):
    rows = [(i, None if i % 2 else "w " * (i % 5 * 11 + i % 3), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += rows[:20] + [(None, "a b", "hot"), (None, "a b", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole, cut = (sorted(map(tuple, mixing.plan_mix(df, cell_rows=n).collect()), key=repr) for n in (1 << 17, cell_rows))
    assert whole == cut


def test_equal_sizes_spread_over_many_cells(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    keyed = mixing._keyed(df, "doc_id", "text", "source", [], F.lit(0))
    coarse = keyed.groupBy(*mixing._CELL).agg(F.count(F.lit(1)).alias("_llm_n"))
    coarse, inner = mixing._cut_on(coarse, keyed, 5000)
    assert coarse.count() == 16 and inner.count() == 16 * 16
    assert keyed.join(coarse, mixing._CELL).groupBy(*mixing._CELL, *mixing._fine()).count().agg(F.max("count")).first()[0] < 5000
