"""Dense-vector operators.

Vectors are ``array<float|double>`` columns (``array_to_vector`` converts for
Spark ML).  Cosine similarity is computed only for an explicit table of
candidate pairs: two equi-joins on the ids, with vectors normalised once per
vector beforehand, so each pair costs one dot product; or, for a stated query
set, as an exact top-k that rules out whole cells of vectors.  An all-pairs matrix would be an n-squared
cross join and is deliberately not offered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import scratch_dir

_BLOCK = 1 << 20  # numbers of one matrix in a task's Python


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit-length copy (NULL for a zero vector)."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


# ---------------------------------------------------------------- J08
def cosine_pairs(vectors: DataFrame, pairs: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                 left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Cosine similarity for each ``(left, right)`` pair of ``pairs``."""
    unit = vectors.select(F.col(id_col), normalized(F.col(vec)).alias("_u"))
    a = unit.select(F.col(id_col).alias(left), F.col("_u").alias("_a"))
    b = unit.select(F.col(id_col).alias(right), F.col("_u").alias("_b"))
    j = pairs.select(left, right).join(a, left, "inner").join(b, right, "inner")
    return j.select(left, right, _dot(F.col("_a"), F.col("_b")).alias("cosine"))


def successor_pairs(vectors: DataFrame, id_col: str = "vec_id", step: int = 1) -> DataFrame:
    """Pairs ``(id, id + step)`` that both exist (an equi-join, no window)."""
    ids = vectors.select(F.col(id_col).alias("left_id"))
    nxt = vectors.select(F.col(id_col).alias("right_id"))
    return ids.join(nxt, F.col("left_id") + step == F.col("right_id"), "inner")


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


class _Cells:
    """Vectors around pivots: each belongs to the nearest, and no vector of a
    cell is farther from its pivot than the cell's radius (an angle, for which the
    triangle inequality holds)."""

    def __init__(self, v: DataFrame, n_pivots: int, chunk_rows: int, name: str):
        spark = v.sparkSession
        # equal vectors are one pivot; drawn by hash, so reruns agree
        drawn = v.select("u").distinct().orderBy(F.xxhash64("u"), "u").limit(n_pivots).collect()
        self.dim = len(drawn[0].u) if drawn else 1
        self.pivots = np.array([r.u for r in drawn], float).reshape(-1, self.dim)
        pivots, dim, kind = self.pivots, self.dim, v.schema["id"].dataType.simpleString()

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _angles(_units(batch.column("u"), dim), pivots)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(cell, pa.int32()),
                                                  pa.array(far[np.arange(len(far)), cell])], ["id", "u", "cell", "far"])

        path = scratch_dir(spark, name)
        v.mapInArrow(dealt, f"id {kind}, u array<double>, cell int, far double").write.parquet(path)
        held = spark.read.parquet(path)
        per = {r.cell: r for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}  # n_pivots rows
        k = range(len(self.pivots))
        self.size = np.array([per[i].n if i in per else 0 for i in k], np.int64)
        self.radius = np.array([per[i].r if i in per else -4.0 for i in k])
        # a large cell is several chunks
        self.chunks = -(-self.size // chunk_rows)
        counts = F.array(*[F.lit(int(max(1, c))) for c in self.chunks]) if len(drawn) else F.array(F.lit(1))
        self.rows = held.select("id", "u", "cell", F.pmod(F.xxhash64("id", "u"), F.get(counts, F.col("cell"))).cast("int").alias("chunk"))


def top_k_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec: str = "embedding",
                 n_pivots: int = 256, chunk_rows: int = 20_000, visits: dict | None = None) -> DataFrame:
    """``(query_id, rank, id, cosine)``: for a stated query set the ``k`` most
    similar vectors of other ids, exactly (ties to 9 decimals: smaller id).
    Vectors of one length; zero vectors take no part.

    Vectors lie in cells around pivots, in chunks of about ``chunk_rows``.  A
    query first visits the nearest cells that hold more than ``k`` vectors; the
    ``k``-th best found there rules out every cell whose vectors are all
    farther by the triangle inequality (angle to the pivot less the cell's radius),
    and only the others are visited.  Each chunk is sent once, in front of the
    queries that visit it.

    In clustered data few cells are left.  The worst case is that of vectors
    all about equally far from each other (independent, of many dimensions): no cell is
    ruled out, and the work is queries times vectors.  ``visits``, if given,
    gets the number of (query, chunk) visits ``made`` and ``possible``.
    """
    v = vectors.select(F.col(id_col).alias("id"), normalized(F.col(vec)).alias("u")).where("u is not null and size(u) > 0")
    q = queries.select(F.col(id_col).alias("query_id"), normalized(F.col(vec)).alias("u")).where("u is not null and size(u) > 0")
    cells = _Cells(v, n_pivots, chunk_rows, "cosine-cells")
    q_kind, kind = q.schema["query_id"].dataType.simpleString(), v.schema["id"].dataType.simpleString()
    spark, dim, pivots, size, radius = v.sparkSession, cells.dim, cells.pivots, cells.size, cells.radius
    if not len(pivots):
        return spark.createDataFrame([], f"query_id {q_kind}, rank int, id {kind}, cosine double")
    visit = f"query_id {q_kind}, u array<double>, bound double, cell int"

    def plan(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """The cells that each query visits first, or those left for it given its bound."""
        rows = max(1, _BLOCK // max(1, len(pivots) * dim))  # a query may visit every cell, each time with its vector
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            far = _angles(_units(batch.column("u"), dim), pivots)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(size[order], 1) - size[order]
            near = np.zeros(far.shape, bool)
            np.put_along_axis(near, order, (before <= k) & (size[order] > 0), 1)
            if not first:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                best = np.cos(np.clip(far - radius, 0, np.pi))
                near = ~near & (size > 0) & (best >= bound[:, None] - 1e-8)
            row, cell = np.nonzero(near)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("query_id", "u", "bound")], pa.array(cell, pa.int32())],
                                             ["query_id", "u", "bound", "cell"])

    def search(asked: DataFrame) -> DataFrame:
        """The ``k`` best of every chunk for the queries that visit its cell."""
        n_chunks = F.array(*[F.lit(int(max(1, c))) for c in cells.chunks])
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(n_chunks, F.col("cell")) - 1)))
        none = [F.lit(None).cast(q_kind).alias("query_id"), F.lit(None).cast("double").alias("bound")]
        both = cells.rows.select("cell", "chunk", "id", "u", *none, F.lit(0).alias("turn")).union(
            asked.select("cell", "chunk", F.lit(None).cast(kind).alias("id"), "u", "query_id", "bound", F.lit(1).alias("turn")))
        both = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "turn")
        return both.mapInArrow(lambda batches: _best_of_chunks(batches, dim, k), f"query_id {q_kind}, id {kind}, cosine double")

    asked = q.withColumn("bound", F.lit(-2.0))
    path = scratch_dir(spark, "cosine-first")
    first = asked.mapInArrow(lambda b: plan(b, True), visit)
    search(first).write.parquet(path)
    found = spark.read.parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), F.col("id")))
    kth = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("cosine").alias("_c"))
    bounded = q.join(kth, F.col("query_id") == F.col("_q"), "left").select("query_id", "u", F.coalesce("_c", F.lit(-2.0)).alias("bound"))
    later = bounded.mapInArrow(lambda b: plan(b, False), visit)
    if visits is not None:
        chunks = F.get(F.array(*[F.lit(int(c)) for c in cells.chunks]), F.col("cell"))
        made = first.select("cell").union(later.select("cell")).agg(F.sum(chunks)).first()[0] or 0
        visits.update(made=int(made), possible=int(cells.chunks.sum()) * q.count())
    every = found.union(search(later))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _nearest(sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of its ``k`` largest values to 9 decimals, equal ones by smaller id."""
    grade = np.where(np.isnan(sim), -np.inf, np.round(sim, 9))
    if len(ids) > k:
        # all at or above the k-th largest, which ties may make more than k
        row, at = np.nonzero(grade >= np.partition(grade, -k, axis=1)[:, -k][:, None])
    else:
        row, at = (a.ravel() for a in np.indices(grade.shape))
    order = np.lexsort((ids[at], -grade[row, at], row))
    row, at = row[order], at[order]
    start = np.searchsorted(row, np.arange(len(sim)))
    return at[start[:, None] + np.arange(min(k, len(ids)))]


def _best_of_chunks(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (cell, chunk, turn), vectors before queries: every
    query's ``k`` nearest vectors of other ids in the chunk.  Queries are taken
    in blocks of at most ``_BLOCK`` similarities, so memory is that of the chunk."""
    here, parts, ids, units = None, [], None, None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("cell", "chunk", "turn")])
        turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if key[2, a] == 0:
                if here != tuple(key[:2, a]):
                    here, parts = tuple(key[:2, a]), []
                parts.append(piece)
                units = None
                continue
            if here != tuple(key[:2, a]):
                continue  # a chunk without vectors
            if units is None:
                held = pa.Table.from_batches(parts)
                ids, units = held.column("id").to_numpy(), _units(held.column("u").combine_chunks(), dim)
            block = max(1, _BLOCK // max(1, len(ids)))
            for i in range(0, b - a, block):
                mine = piece.slice(i, block)
                own = mine.column("query_id").to_numpy(zero_copy_only=False)
                sim = _units(mine.column("u"), dim) @ units.T
                sim[own[:, None] == ids[None]] = -np.inf
                order = _nearest(sim, ids, k)
                near = np.take_along_axis(sim, order, 1)
                keep = near > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, keep.sum(1)), batch.column("query_id").type),
                                                  pa.array(ids[order[keep]], batch.column("id").type), pa.array(near[keep])],
                                                 ["query_id", "id", "cosine"])


# ---------------------------------------------------------------- M02
def pool_features(df: DataFrame, tokens: str = "token_vectors", mask: str = "attention_mask",
                  how: str = "last", out_col: str = "pooled") -> DataFrame:
    """Pick one token vector per row: the last real token (index =
    sum(mask) - 1) or the first token; NULL when the mask is empty."""
    if how == "last":
        idx = F.aggregate(F.col(mask), F.lit(0), lambda s, m: s + m) - 1
    elif how == "first":
        idx = F.lit(0)
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return df.withColumn(out_col, F.when(idx >= 0, F.get(F.col(tokens), idx)))


def token_matrix(df: DataFrame, vec: str, width: int, out_col: str = "token_vectors") -> DataFrame:
    """Cut a flat vector into consecutive ``width``-sized token vectors."""
    n = F.size(F.col(vec))
    return df.withColumn(out_col, F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1),
                                              lambda i: F.slice(F.col(vec), i * width + 1, width)))


# ---------------------------------------------------------------- M03
def fuse_features(df: DataFrame, cols: Sequence[str], out_col: str = "features") -> DataFrame:
    """Concatenate array / vector / numeric columns into one ML vector."""
    tmp, names = df, []
    for c in cols:
        t = dict(df.dtypes)[c]
        if t.startswith("array"):
            tmp = tmp.withColumn(f"_v_{c}", array_to_vector(F.transform(F.col(c), lambda x: x.cast("double"))))
            names.append(f"_v_{c}")
        else:
            names.append(c)
    out = VectorAssembler(inputCols=names, outputCol=out_col).transform(tmp)
    return out.drop(*[n for n in names if n.startswith("_v_")])


def vector_summary(df: DataFrame, vec: str = "features") -> DataFrame:
    arr = vector_to_array(F.col(vec))
    return df.select("*", F.size(arr).alias("dim"), F.aggregate(arr, F.lit(0.0), lambda s, x: s + x).alias("vsum"))
