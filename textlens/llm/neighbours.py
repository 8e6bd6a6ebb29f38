"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors are one node.  Nodes are dealt into shards; in each shard a
graph is grown in batches of doubling size: a greedy (beam) search from the
shard's centre proposes neighbours, pruning keeps the nearest and drops every
candidate that a kept one brings ``relax`` times closer, and the edges are
added in both directions, pruned again where a node has too many.  The graphs
are a table (one row per node).  Every query walks every shard's graph by beam
search; the best of all shards, rescored in double precision on the original
vectors, are merged.

A shard is as large as a task's memory allows (``shard_bytes`` of vectors), but
there are as many as the cluster has cores while the table is small.  So the
number of shards is constant up to cores times ``shard_bytes``, and rows sent grow in
proportion to the table; beyond that each query goes to one more shard per
``shard_bytes``, which a search of every shard implies.  A shard is sent once: its
nodes come first in its partition, and the queries stream past them in
batches.  Memory per task: one shard and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import staged

_STEP = 4  # nodes expanded at a time
_BATCH = 512


def beam_search(unit: np.ndarray, edges: np.ndarray, start: int, query: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all rows of ``query`` at once: ``(ids, nearness)``, the
    ``beam`` best nodes seen, nearest first (-1 beyond the last).  ``unit``:
    unit vectors, ``edges``: node ids per node, -1 for none."""
    m = len(query)
    ids = np.full((m, beam), -1, np.int64)
    near = np.full((m, beam), -np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    ids[:, 0], near[:, 0] = start, query @ unit[start]
    live = np.arange(m)
    while len(live):
        here, open_ = ids[live], ~done[live] & (ids[live] >= 0)
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :_STEP]
        use = np.take_along_axis(open_, pick, 1)
        nodes = np.where(use, np.take_along_axis(here, pick, 1), -1)
        mark = done[live]
        np.put_along_axis(mark, pick, True, 1)
        done[live] = mark | (here < 0)
        found = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(live), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[(found[:, :, None] == here[:, None, :]).any(2)] = -1
        score = np.einsum("md,mcd->mc", query[live], unit[found], optimize=False).astype(np.float32)
        score[found < 0] = -np.inf
        all_ids, all_near = np.hstack([here, found]), np.hstack([near[live], score])
        all_done = np.hstack([done[live], np.zeros(found.shape, bool)])
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(all_near, best, 1)
        ids[live] = np.where(near[live] > -np.inf, np.take_along_axis(all_ids, best, 1), -1)
        done[live] = np.take_along_axis(all_done, best, 1)
        live = live[(~done[live] & (ids[live] >= 0)).any(1)]
    return ids, near


def robust_prune(unit: np.ndarray, point: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row, up to ``degree`` of the candidates ``cand`` (-1: none):
    the nearest one left is kept, and those that it brings ``relax`` times
    closer than the point itself are dropped."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == point[:, None]] = -1
    vec = unit[cand]
    far = np.maximum(2 - 2 * np.einsum("md,mcd->mc", unit[point], vec, optimize=False), 0)  # squared distance
    far[cand < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
    vec = np.take_along_axis(vec, order[:, :, None], 1)
    alive = cand >= 0
    out = np.full((len(point), degree), -1, np.int64)
    rows = np.arange(len(point))
    for k in range(degree):
        first = alive.argmax(1)
        any_ = alive[rows, first]
        if not any_.any():
            break
        out[any_, k] = cand[rows, first][any_]
        between = np.maximum(2 - 2 * np.einsum("md,mcd->mc", vec[rows, first], vec, optimize=False), 0)
        alive &= ~((relax * relax * between <= far) & any_[:, None])
        alive[rows, first] = False
    return out


def build_graph(unit: np.ndarray, degree: int, beam: int, relax: float, seed: int) -> tuple[np.ndarray, int]:
    """``(edges, start)`` over unit vectors."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int64)
    start = int(np.argmax(unit @ unit.mean(0)))
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        points = order[at:at + size]
        at, size = at + size, min(2 * size, _BATCH)
        ids, _ = beam_search(unit, edges, start, unit[points], beam)
        # the batch's own points are each other's candidates too, as none is in the graph yet
        peers = np.argsort(-(unit[points] @ unit[points].T), axis=1)[:, :degree // 2]
        edges[points] = robust_prune(unit, points, np.hstack([ids, points[peers]]), degree, relax)
        source = np.repeat(points, degree)
        target = edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        back = np.full((len(nodes), width), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.hstack([edges[nodes], back])
        for k in range(0, len(nodes), _BATCH):
            part = both[k:k + _BATCH]
            edges[nodes[k:k + _BATCH]] = _join(unit, nodes[k:k + _BATCH], part, degree, relax)
    return edges, start


def _join(unit: np.ndarray, point: np.ndarray, both: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """``both`` without repeats where it fits ``degree``, else pruned."""
    both = np.sort(both, axis=1)[:, ::-1]
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    fits = (both >= 0).sum(1) <= degree
    out = -np.sort(-both, axis=1)[:, :degree]
    out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    if (~fits).any():
        out[~fits] = robust_prune(unit, point[~fits], both[~fits], degree, relax)
    return out


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two that brings their largest component to [0.5, 1),
    which changes no cosine and no digit, so squares neither overflow nor vanish; and unit vectors."""
    v = vectors.astype(float)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return v, (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def shard_counts(nodes: DataFrame, shard_bytes: int, shard_rows: int) -> DataFrame:
    """``(dim, shards)``: into how many shards the vectors of each length go."""
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    by_memory = F.ceil(F.col("n") * F.col("dim") * 8 / shard_bytes)
    by_cores = F.least(F.lit(cores), F.ceil(F.col("n") / shard_rows))
    per = nodes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("dim", F.greatest(by_memory, by_cores, F.lit(1)).cast("int").alias("shards"))


def build_index(nodes: DataFrame, shard_bytes: int = 128 << 20, shard_rows: int = 4096, degree: int = 32, beam: int = 64,
                relax: float = 1.2, seed: int = 6) -> DataFrame:
    """``(dim, shard, place, node, vector, edges, start)`` from ``nodes(node, vector)``:
    one row per node; ``place`` counts the nodes of a shard from 0, ``edges``
    are places in the same shard, ``start`` marks where searches begin.
    Vectors of different length never share a shard.  While there are more
    cores than shards, shards of down to ``shard_rows`` are made."""
    counts = staged(shard_counts(nodes, shard_bytes, shard_rows), "shards")
    total = counts.agg(F.sum("shards")).first()[0] or 1
    dealt = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("shards")).cast("int")
    keyed = nodes.withColumn("dim", F.size("vector")).join(counts, "dim").select("dim", dealt.alias("shard"), "node", "vector")

    def graph(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        edges, start = build_graph(_scaled(_matrix(rows.column("vector").combine_chunks()))[1], degree, beam, relax, seed)
        place = np.arange(len(edges))
        kept = edges >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32()),
                                         pa.array(edges[kept], pa.int32()))
        return pa.table({"dim": rows.column("dim"), "shard": rows.column("shard"), "place": pa.array(place, pa.int32()),
                         "node": rows.column("node"), "vector": rows.column("vector"), "edges": lists, "start": pa.array(place == start)})

    kind = nodes.schema["node"].dataType.simpleString()
    # a given number of partitions: small shards stay apart, one task each
    return staged(keyed.repartition(4 * int(total), "dim", "shard").groupBy("dim", "shard").applyInArrow(
        graph, f"dim int, shard int, place int, node {kind}, vector array<double>, edges array<int>, start boolean"), "graph")


class _Shard:
    """The graph of one shard, put together from its rows."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.names = rows.column("node").combine_chunks()
        self.vectors, self.unit = _scaled(_matrix(rows.column("vector").combine_chunks()))
        lists = rows.column("edges").combine_chunks()
        count = lists.value_lengths().to_numpy()
        self.edges = np.full((len(count), max(1, int(count.max()))), -1, np.int64)
        self.edges[np.arange(self.edges.shape[1]) < count[:, None]] = lists.flatten().to_numpy()
        self.start = int(np.flatnonzero(rows.column("start").to_numpy())[0])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))

    def nearest(self, asked: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, place, cosine)`` of the ``k`` best found for every row."""
        v, unit = _scaled(asked)
        ids, _ = beam_search(self.unit, self.edges, self.start, unit, max(beam, k))
        score = (v[:, None, :] * self.vectors[ids]).sum(2) / (np.sqrt((v * v).sum(1))[:, None] * self.norms[ids])
        score[ids < 0] = -np.inf
        best = np.lexsort((ids, -score))[:, :k]
        row, ids, score = np.repeat(np.arange(len(v)), best.shape[1]), np.take_along_axis(ids, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
        return row[ids >= 0], ids[ids >= 0], score[ids >= 0]


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = 96) -> DataFrame:
    """``(query, node, score)``: of each shard the ``k`` nodes nearest to every
    row of ``queries(query, vector)`` that its beam search finds, with their
    cosine in double precision.  Each shard is sent to one task once, in front
    of its queries."""
    shards = staged(index.where("start").select(F.col("dim").alias("_dim"), "shard"), "shard-list")  # a row each
    total = max(1, shards.count())
    asked = queries.withColumn("dim", F.size("vector")).join(shards, F.col("dim") == F.col("_dim"))
    query_kind, node_kind = queries.schema["query"].dataType.simpleString(), index.schema["node"].dataType.simpleString()
    nothing = {"query": query_kind, "place": "int", "node": node_kind, "edges": "array<int>", "start": "boolean"}
    columns = ["dim", "shard", "query", "place", "node", "vector", "edges", "start"]

    def padded(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(nothing[c]).alias(c) for c in columns])

    both = padded(index).union(padded(asked.select("dim", "shard", "query", "vector")))
    # of a shard the nodes first, by place, then its queries, whose place is null
    both = both.repartition(4 * total, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("place").asc_nulls_last())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, shard = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard")])
            is_node = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
            turn = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0) | (is_node[1:] != is_node[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if is_node[a]:
                    if here != tuple(key[:, a]) or shard is not None:
                        here, parts, shard = tuple(key[:, a]), [], None
                    parts.append(piece)
                    continue
                shard = shard or _Shard(parts)
                for i in range(0, b - a, _BATCH):
                    mine = piece.slice(i, _BATCH)
                    row, place, score = shard.nearest(_matrix(mine.column("vector")), k, beam)
                    yield pa.RecordBatch.from_arrays([mine.column("query").take(pa.array(row)), shard.names.take(pa.array(place)), pa.array(score)],
                                                     ["query", "node", "score"])

    return both.mapInArrow(walk, f"query {query_kind}, node {node_kind}, score double")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            **index_options) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for every row where ``is_query``
    holds the ``k`` rows of largest cosine found, not counting rows of its own
    id, nearest first, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows with a null id; vectors of other lengths than
    the query's are no candidates.  Rows repeated in id and vector count once.
    An id with several vectors stands for each of them.  An empty table gives
    an empty result.  Other columns are not read.

    Equal vectors are one node of the graph, under their smallest id; the
    ``k + 1`` smallest ids of each are kept beside it, which is all that a
    list of ``k`` can name.  Candidates of all copies are thus exact however
    many copies there are.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(valid(F.col("vector")))
    copies = Window.partitionBy("vector").orderBy("id")
    first = rows.groupBy("vector", "id").agg(F.max("asked").alias("asked"))
    ranked = first.withColumn("at", F.row_number().over(copies)).where(F.col("at") <= k + 1)
    smallest = F.min("id").over(Window.partitionBy("vector"))
    node = F.concat_ws(":", smallest.cast("string"), F.hex(F.xxhash64("vector")))
    members = staged(ranked.select("vector", "id", node.alias("node"), "at"), "members")
    nodes = members.where("at = 1").select("node", "vector")
    index = build_index(nodes, **index_options)
    asked = rows.where("asked").select(F.col("id").alias("query"), "vector").distinct()
    found = search_index(index, asked, k + 1)
    each = found.join(members.select("node", "id"), "node").where(F.col("id") != F.col("query"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", best).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
