import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textlens.llm import bisectors
from textlens.llm.queries import op12_bisector_clusters

from .helpers import SF, same_as_sql

KIND = "vec_id long, embedding array<double>"


def brute(rows, dim, k, rounds, scale):
    """Plain distances in Python's integers; rows of (id, components)."""
    def whole(x):
        n, d = x.as_integer_ratio()
        return scale * n // d

    vs = [(i, [whole(float(x)) for x in v]) for i, v in rows]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in vs:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in vs]
    return out, cents


def run(spark, rows, **options):
    df, cents = bisectors.cluster_vectors(spark.createDataFrame(rows, KIND), **options)
    return df.collect(), cents


def same(got, want, cents):
    out, brute_cents = want
    assert [list(p) for p in cents.points] == brute_cents
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == sorted(
        (i is None, i or 0, j, d if d < 2**63 else None) for i, j, d in out)
    for r in got:
        mine = [d for _, j, d in out if j == r.cluster]
        assert r.cluster_inertia == (sum(mine) if max(mine) < 2**63 and sum(mine) < 2**63 else None)


def test_whole_table(spark):
    same_as_sql(op12_bisector_clusters(spark, SF), bisectors.oracle())


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_repeated_rows(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.randint(-2, 2) / 4 for _ in range(3)]) for i in range(120)]
    rows += rows[:40] + [(None, [0.25, 0.25, 0.0]), (None, [0.0, 0.0, 0.0])] + [(500 + i, rows[0][1]) for i in range(60)]
    got, cents = run(spark, rows, dim=3, k=7, rounds=3, scale=4)
    same(got, brute(rows, 3, 7, 3, 4), cents)


def test_equal_first_centroids_leave_empty_ones(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(99, [5.0, -3.5])]
    got, cents = run(spark, rows, dim=2, k=31, rounds=2, scale=2)
    same(got, brute(rows, 2, 31, 2, 2), cents)
    assert len({r.cluster for r in got}) == 2


def test_components_of_any_size_are_exact(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [1e-200, -1e-200]), (4, [2.0**60, -2.0**60]), (5, [3.0, 4.0]),
            (6, [1.7e308, -1.7e308]), (7, [2.0**60 + 2.0**20, -2.0**60]), (8, [0.5, -0.0])]
    got, cents = run(spark, rows, dim=2, k=3, rounds=2, scale=64)
    same(got, brute(rows, 2, 3, 2, 64), cents)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-inf, 1.0]), (8, [1.0, 2.0, 3.0])]
    assert run(spark, rows, dim=2) == ([], bisectors.Centroids(()))
    assert run(spark, [], dim=2)[0] == []
    got, cents = run(spark, [*rows, (9, [1.0, 2.0])], dim=2)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(9, 0, 0, 0)] and cents.points == ((64, 128),)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3, "x"), (2, [2.0, 1.0], 4, "y")], "vec_id long, embedding array<double>, cluster int, vector string")
    out, _ = bisectors.cluster_vectors(df, dim=2, k=2)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and out.count() == 2
    out, _ = bisectors.cluster_vectors(df.select(F.col("embedding").alias("id"), F.col("vec_id").alias("vector")),
                                       id_col="vector", vector_col="id", dim=2, k=2)
    assert out.columns[0] == "vector" and out.count() == 2
