"""Centroid clustering of vectors by a tournament of bisectors.

Vectors are integer vectors, ``floor(scale * x)`` of every component, so all
of the arithmetic is exact.  Of two centroids the nearer one to a vector is
told by the sign of one linear form: with ``i < j``,
``2 * (c_j - c_i) . x <= |c_j|^2 - |c_i|^2`` says that ``i`` is as near as
``j`` or nearer.  Normals and thresholds of all pairs are computed once a
round; a vector then needs ``k - 1`` sign tests, each of which puts one centroid
out: number 0 meets number 1, the winner number 2, and so on.  As the winner so far
has the smaller number, a test that comes out at zero favours it.  Only the distance to the final
winner is computed as such.

A round reads the table once.  Each task sums its vectors per cluster and
component, Spark adds the sums up, and the driver gets ``k`` rows of sums,
whatever the number of vectors.  Nothing is grouped by a value of the data, so
a vector that a third of the rows share is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import staged

#: Components up to this size are handled in 64 bits: a form over 2**12 of them stays under 2**63.
_SMALL = 1 << 24
#: Sums travel in signed digits of so many bits, so that integers of any size add up exactly.
_DIGIT = 40
_LONG = 1 << 63


@dataclass(frozen=True)
class Centroids:
    """Numbered centroids, as tuples of exact integers."""

    points: tuple[tuple[int, ...], ...]

    def digests(self) -> list[str]:
        """SHA-256 of each centroid's components, in decimal and joined by commas."""
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points]


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of double components, for any finite ones: in 64
    bits if all are small, else as Python's integers."""
    if not vectors.size or np.abs(vectors).max() * scale < _SMALL:
        return np.floor(vectors * scale).astype(np.int64)
    # from 2**53 on a double is an integer itself, and scaling it could overflow
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: Centroids):
        c = np.array(centroids.points, object)
        square = (c * c).sum(1)
        self.normals = 2 * (c[None] - c[:, None])  # of the pair i, j
        self.limits = square[None] - square[:, None]
        self.points = c
        self.small = bool(np.abs(c).max() < _SMALL)
        if self.small:
            self.normals, self.limits, self.points = (x.astype(np.int64) for x in (self.normals, self.limits, c))

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(number, squared distance)`` of the nearest centroid of every row."""
        if x.dtype != object and not self.small:
            x = x.astype(object)
        won = np.zeros(len(x), np.int64)
        for j in range(1, len(self.points)):
            side = (self.normals[won, j] * x).sum(1) - self.limits[won, j]
            won[(side > 0).astype(bool)] = j
        gap = x - self.points[won]
        return won, (gap * gap).sum(1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, vector)``: the rows whose vector has exactly ``dim`` components,
    none of them null or not finite."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where((F.size(v) == dim) & fine)


def _matrix(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    return integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def first_centroids(rows: DataFrame, k: int, scale: int, salt: str) -> Centroids:
    """The ``k`` vectors (all, if fewer) with the smallest SHA-256 of the salt
    and the id, in that order; a null id comes last, equal ids are ordered by
    their vectors."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    found = rows.orderBy(h.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return Centroids(tuple(tuple(int(x) for x in integers(np.array(r.vector, float), scale)) for r in found))


def next_centroids(rows: DataFrame, now: Centroids, scale: int) -> Centroids:
    """One round: every vector goes to its nearest centroid, and each centroid
    to the floor of its vectors' mean; one without vectors stays."""
    dim = len(now.points[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Tournament(now)
        total = np.zeros((len(now.points), dim), object)
        count = np.zeros(len(now.points), np.int64)
        for batch in batches:
            x = _matrix(batch, dim, scale)
            won, _ = match.winners(x)
            part = np.zeros(total.shape, x.dtype)
            np.add.at(part, won, x)
            total += part
            count += np.bincount(won, minlength=len(count))
        out: list[tuple[int, int, int, int]] = [(j, -1, 0, int(n)) for j, n in enumerate(count) if n]
        for (j, d), s in np.ndenumerate(total):
            sign, rest, place = (-1 if s < 0 else 1), abs(int(s)), 0
            while rest:
                out.append((j, d, place, sign * (rest & ((1 << _DIGIT) - 1))))
                rest, place = rest >> _DIGIT, place + 1
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:3]] + [pa.array(columns[3], pa.int64())],
                                         ["cluster", "component", "place", "part"])

    parts = rows.select("vector").mapInArrow(sums, "cluster int, component int, place int, part long")
    added = parts.groupBy("cluster", "component", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    total: dict[tuple[int, int], int] = {}
    for r in added.collect():  # of k * dim sums
        key = r.cluster, r.component
        total[key] = total.get(key, 0) + (int(r.part) << (_DIGIT * r.place))
    return Centroids(tuple(
        tuple(total.get((j, d), 0) // total[j, -1] for d in range(dim)) if (j, -1) in total else point
        for j, point in enumerate(now.points)))


def assign(rows: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    """``(id, cluster, distance)`` of every row of ``rows(id, vector)``; a
    distance of 2**63 or more is null."""
    dim = len(centroids.points[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Tournament(centroids)
        for batch in batches:
            won, far = match.winners(_matrix(batch, dim, scale))
            fits = pa.array([int(d) if d < _LONG else None for d in far], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(won, pa.int32()), fits],
                                             ["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64,
                    k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1:") -> tuple[DataFrame, Centroids]:
    """``(rows, centroids)``: per vector ``id_col``, ``cluster``, ``distance``
    (squared), ``cluster_inertia`` and ``inertia`` (distances summed over its
    cluster and over all), and the centroids after ``rounds`` rounds.

    Vectors that are null, of another length than ``dim``, or hold null or
    non-finite components take no part.  Every other row counts, repeated ones
    as often as they stand there, also with a null id.  Ties go to the centroid
    of the smaller number, also between equal centroids.  With fewer than ``k``
    vectors each is a first centroid; an empty table gives an empty result and
    no centroids.  Components of any finite size are exact; a distance or a sum
    that does not fit a long is null.  Other columns are not read.
    """
    rows = integer_vectors(vectors, id_col, vector_col, dim)
    centroids = first_centroids(rows, k, scale, salt)
    if not centroids.points:
        kind = rows.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, scale)
    held = staged(assign(rows, centroids, scale), "clusters")
    # k sums at most; one unknown distance leaves its sums unknown
    known = F.count(F.lit(1)) == F.count("distance")
    total = F.when(known, F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.total for r in held.groupBy("cluster").agg(total.alias("total")).collect()}
    every = None if None in per.values() else sum(per.values())

    def long(x) -> int | None:
        return None if x is None or x >= _LONG else int(x)

    sums = F.array(*[F.lit(long(per.get(j, 0))).cast("long") for j in range(len(centroids.points))])
    return held.select(F.col("id").alias(id_col), "cluster", "distance", F.get(sums, F.col("cluster")).alias("cluster_inertia"),
                       F.lit(long(every)).cast("long").alias("inertia")), centroids


def oracle(dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1:") -> str:
    """DuckDB SQL for the query: plain distances to all centroids in every round."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT) for y in embedding] AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len([y for y in embedding if y IS NOT NULL AND isfinite(y)]) = {dim}),
p AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
c0 AS MATERIALIZED (
  SELECT j, unnest(x) AS c, generate_subscripts(x, 1) AS i
  FROM (SELECT x, row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, x) - 1 AS j FROM v) t WHERE j < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS MATERIALIZED (SELECT r, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM p JOIN c{n} USING (i) GROUP BY r, j),
a{n} AS MATERIALIZED (SELECT r, min(d) AS d, CAST(min_by(j, (d, j)) AS INT) AS j FROM d{n} GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT j, i, CAST(floor_div AS BIGINT) AS c FROM (
  SELECT j, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM p JOIN a{n} USING (r) GROUP BY j, i) t),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c, c.i FROM c{n} c LEFT JOIN m{n} m USING (j, i))""")
    return "WITH" + ",".join(steps) + f""",
h AS (SELECT CAST(j AS INT) AS j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (j)
"""
