import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from textlens.llm import sharding
from textlens.llm.queries import op9_shuffle_shards

from .helpers import SF, no_documents, odd_documents


def check_law(rows, shards=16):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(j, 0) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for j in range(shards):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(sizes[j]))


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_shuffle_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_law(rows)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = op9_shuffle_shards(spark, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_matrix_is_the_inverted_law(spark):
    """Every entry equals the exact inversion, in rational arithmetic, of the
    hypergeometric distribution at the same uniform."""
    cells = [(c, n) for c, n in enumerate([7, 0, 25, 1, 60, 13, 200]) if n]
    shards, seed = 5, 3
    df = spark.createDataFrame(cells, "cell int, n long")
    got = {r.cell: list(r.sent) for r in sharding.communication_matrix(df, shards, seed).collect()}
    total = sum(n for _, n in cells)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    for c, n in cells:
        left, drawn, want = sum(room), n, []
        for j in range(shards):
            u = spark.range(1).select(sharding._uniform(F.lit(seed), F.lit(c), F.lit(j + 1))).first()[0]
            run, pick = Fraction(0), None
            for k in range(max(0, drawn + room[j] - left), min(drawn, room[j]) + 1):
                run += Fraction(comb(room[j], k) * comb(left - room[j], drawn - k), comb(left, drawn))
                if run > Fraction(u):
                    pick = k
                    break
            want.append(pick)
            left, drawn = left - room[j], drawn - pick
        room = [r - x for r, x in zip(room, want)]
        assert got[c] == want and sum(want) == n
    assert room == [0] * shards


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(0, 3_000_000), (1, 5_000_000), (2, 2_000_001)], "cell int, n long")
    got = {r.cell: list(r.sent) for r in sharding.communication_matrix(df, 4, 1).collect()}
    assert [sum(v) for _, v in sorted(got.items())] == [3_000_000, 5_000_000, 2_000_001]
    cols = [sum(v[j] for v in got.values()) for j in range(4)]
    assert max(cols) - min(cols) <= 1 and sum(cols) == 10_000_001
    assert all(abs(v[j] - sum(v) / 4) < 8000 for v in got.values() for j in range(4))  # some ten standard deviations


def test_shuffle_is_even(spark):
    """Each document's shard is uniform over seeds (chi-square per document pooled)."""
    df = spark.createDataFrame([(i, "x") for i in range(40)], "doc_id long, text string")
    hits = Counter()
    for seed in range(12):
        rows = sharding.shuffle_to_shards(df, n_shards=4, seed=seed * 10).collect()
        check_law(rows, 4)
        hits.update((r.doc_id % 4, r.shard) for r in rows)
    chi = sum((hits[a, b] - 30) ** 2 / 30 for a in range(4) for b in range(4))
    assert chi < 40  # 9 degrees of freedom


@pytest.mark.parametrize("cell_rows", [1, 1 << 20])
def test_odd_documents(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    docs = odd_documents(spark, ["shard", "SLOT", "cell", "n"])
    out = sharding.shuffle_to_shards(docs, cell_rows=cell_rows, carry=("lang", "shard", "cell"))
    assert out.columns == ["lang", "cell", "doc_id", "size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == docs.count()
    check_law(rows)
    assert sorted(r.size for r in rows) == sorted(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert sharding.shuffle_to_shards(no_documents(spark)).collect() == []


def test_cells_of_cells_follow_the_law(spark, monkeypatch):
    """Two and three levels: rows and columns of the matrix sum up, and counts are those of a uniform shuffle."""
    monkeypatch.setattr(sharding, "FAN", 4)
    cells = [(c, 1000 + 37 * c) for c in range(64) if c % 7]
    df = spark.createDataFrame(cells, "cell int, n long")
    total = sum(n for _, n in cells)
    for levels in (2, 3):
        got = {r.cell: list(r.sent) for r in sharding.communication_matrix(df, 5, 1, levels).collect()}
        assert {c: sum(v) for c, v in got.items()} == dict(cells)
        columns = [sum(v[j] for v in got.values()) for j in range(5)]
        assert columns == [total // 5 + (j < total % 5) for j in range(5)]
        off = [(v[j] - sum(v) / 5) / (sum(v) * 0.16) ** 0.5 for v in got.values() for j in range(5)]
        assert max(map(abs, off)) < 5 and 0.7 < sum(x * x for x in off) / len(off) < 1.3


def test_repeated_rows_are_ranked_as_one(spark):
    df = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("again").alias("text")).union(
        spark.range(30_000).select(F.col("id") + 10, F.col("id").cast("string")))
    out = sharding.shuffle_to_shards(df)
    rows = out.collect()
    check_law(rows)
    assert Counter(r.doc_id == 7 for r in rows) == {True: 60_000, False: 30_000}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_numbers_of_cells_and_blocks_follow_the_rows(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    monkeypatch.setattr(sharding, "FAN", 8)
    made = []
    real = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda cells, n, seed, levels=1: made.append(levels) or real(cells, n, seed, levels))
    for cell_rows in (1000, 50, 6):
        check_law(sharding.shuffle_to_shards(df, cell_rows=cell_rows).collect())
    assert [m for m in made if m == max(made)] and sorted(set(made)) == [1, 2, 3]
