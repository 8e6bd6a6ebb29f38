"""Python memory and work per row of vector search and sampled attribution."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textlens.operators import scoring as S
from textlens.operators import vectors as V


def _chunk(n: int, first: int, turn: int, u: np.ndarray) -> pa.RecordBatch:
    ids, none = pa.array(range(first, first + n), pa.int64()), pa.nulls(n, pa.int64())
    col = pa.array(list(u), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), none if turn else ids, col,
                                       ids if turn else none, pa.array([turn] * n, pa.int32())],
                                      ["cell", "chunk", "id", "u", "query_id", "turn"])


def test_best_of_a_large_chunk_takes_small_blocks():
    rnd = np.random.default_rng(3)
    v, q = rnd.normal(size=(6000, 4)), rnd.normal(size=(900, 4))
    v[17] = np.nan
    batches = [_chunk(6000, 0, 0, v), _chunk(900, 3000, 1, q)]
    tracemalloc.start()
    got = pa.Table.from_batches(list(V._best_of_chunks(iter(batches), 4, 3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20  # 900 x 6000 similarities in one block take over 130 MB
    sim = np.where(np.isnan(q @ v.T), -np.inf, q @ v.T)
    sim[np.arange(900), np.arange(3000, 3900)] = -np.inf
    assert got.column("id").to_pylist() == np.argsort(-sim, axis=1)[:, :3].ravel().tolist()


def test_nearest_takes_ties_by_smaller_id():
    sim = np.array([[1.0, 2, 2, 2], [0, 0, 0, 0]])
    assert V._nearest(sim, np.array([4, 9, 3, 5]), 2).tolist() == [[2, 3], [2, 0]]
    assert V._nearest(sim[:, :1], np.array([4]), 2).tolist() == [[0], [0]]


def test_masks_are_the_seeded_hash(spark):
    rows = spark.range(5).select(F.col("id").cast("int").alias("s")).crossJoin(spark.range(7).select(F.col("id").cast("int").alias("j")))
    for seed in (42, -3):
        want = rows.select("s", "j", (F.abs(F.xxhash64(F.lit("a|1"), "s", "j", F.lit(seed))) % 2).alias("m")).collect()
        key = spark.range(1).select(F.xxhash64(F.lit("a|1"))).first()[0]
        got = S._masks(key, 7, 5, seed)
        assert all(got[r.s, r.j] == (r.s == 0 or r.m == 1) for r in want)


def test_sampled_attribution_sends_a_text_once(spark, capsys):
    d = spark.createDataFrame([(1, "a b zzmark"), (None, "zzmark c"), (2, " "), (3, None), (4, "zzmark d"), (4, "zzmark d")], "id int, text string")
    out = S.sampled_attribution(d, S.marker_predictor, ["id"], "text")
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroups" not in plan and "Generate" not in plan  # no row per sample
    best = sorted((str(r.id), r.pos, r.token) for r in out.where("rank = 1").collect())
    assert best == [("1", 2, "zzmark"), ("4", 0, "zzmark"), ("None", 0, "zzmark")]
