"""Concept-graph operators.

The graph is three tables: labels ``(text, lang, concept)``, edges
``(start, relation, end, uri)``.  All operators are equi-joins and
grouped aggregates; per-key top-k cuts use ``row_number() <= k``, which
Spark plans as a WindowGroupLimit (a partial limit on the map side), so a
hub node with a third of all edges does not land whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.operators.prep import GRAPH_RELATIONS, relation_filter


def edges_from(df: DataFrame, start: str = "src", relation: str = "rel", end: str = "dst") -> DataFrame:
    """Edge table with a stable uri ``/a/[/r/<rel>/,<start>,<end>/]``."""
    return df.select(
        F.col(start).alias("start"), F.col(relation).alias("relation"), F.col(end).alias("end"),
        F.concat(F.lit("/a/[/r/"), F.col(relation), F.lit("/,"), F.col(start), F.lit(","), F.col(end),
                 F.lit("/]")).alias("uri"))


# ---------------------------------------------------------------- W02
def top_concept(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per label ``(text, lang)``: the concept with the most outgoing edges
    (ties: smallest concept id), with its edge count."""
    deg = edges.groupBy(F.col("start").alias("concept")).agg(F.count(F.lit(1)).alias("n_edges"))
    j = labels.join(deg, "concept", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    w = Window.partitionBy("text", "lang").orderBy(F.col("n_edges").desc(), F.col("concept").asc())
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "text", "lang", "concept", "n_edges")


# ---------------------------------------------------------------- J05 (+ W04)
def concept_neighbours(words: DataFrame, labels: DataFrame, edges: DataFrame,
                       allowed: Sequence[str] = GRAPH_RELATIONS, limit: int = 20) -> DataFrame:
    """For many ``(text, lang)`` words at once: the word's busiest concept,
    its edges in the allow-list ordered by uri, the first ``limit`` numbered
    from 1, with the end concept's label."""
    top = top_concept(labels.join(words.select("text", "lang").distinct(), ["text", "lang"], "left_semi"), edges)
    e = relation_filter(edges, allowed, "relation")
    # ``top`` is an aggregate output (one row per word): AQE sees its real
    # size and broadcasts it, so a hub concept's edges are never shuffled.
    j = e.join(top.select("text", "lang", F.col("concept").alias("start")), "start", "inner")
    w = Window.partitionBy("text", "lang").orderBy(F.col("uri").asc())
    first = j.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= limit)
    end_label = labels.groupBy(F.col("concept").alias("end")).agg(F.min("text").alias("end_label"))
    return first.join(end_label, "end", "left").select(
        F.col("text").alias("word"), "lang", "idx", "relation", "start", "end", "end_label", "uri")


# ---------------------------------------------------------------- J09
def two_hop_classes(seeds: DataFrame, edges: DataFrame, seed: str = "seed", a: str = "start",
                    b: str = "end") -> DataFrame:
    """Undirected neighbourhood of each seed: degree 0 (``selected``), 1
    (``first``), 2 (``second``); the nearer class wins.  Nodes not listed
    are ``other``.  Frontiers are de-duplicated before each expansion."""
    s = seeds.select(F.col(seed).alias("seed")).distinct()
    d0 = s.select("seed", F.col("seed").alias("node"), F.lit(0).alias("degree"))
    # Both directions from one pass over the edges.  The frontier (small next to
    # them: adaptive execution broadcasts it) prunes them first; only the new
    # frontier is de-duplicated.
    both = F.array(F.struct(F.col(a).alias("_u"), F.col(b).alias("_v")),
                   F.struct(F.col(b).alias("_u"), F.col(a).alias("_v")))
    hops = edges.select(F.explode(both).alias("_e")).select("_e._u", "_e._v")

    def step(frontier: DataFrame) -> DataFrame:
        return hops.join(frontier, F.col("node") == F.col("_u")).select("seed", F.col("_v").alias("node")).distinct()

    d1 = step(d0.select("seed", "node"))
    d2 = step(d1)
    allr = d0.unionByName(d1.withColumn("degree", F.lit(1))).unionByName(d2.withColumn("degree", F.lit(2)))
    best = allr.groupBy("seed", "node").agg(F.min("degree").alias("degree"))
    cls = F.when(F.col("degree") == 0, "selected").when(F.col("degree") == 1, "first").otherwise("second")
    return best.select("seed", "node", "degree", cls.alias("class"))


# ---------------------------------------------------------------- J10
def _matchable(values: Sequence) -> list:
    # The empty text and zero never select anything; the text "0" does.
    return [v for v in values if v is not None and v != "" and not (isinstance(v, (int, float)) and v == 0)]


def select_nodes_by_property(nodes: DataFrame, prop: str, values: Sequence, node: str = "node") -> DataFrame:
    """All nodes with a ``hidden`` flag: shown iff ``prop`` is one of ``values``."""
    vals = _matchable(values)
    shown = F.col(prop).isin(vals) if vals else F.lit(False)
    return nodes.select("*", (~F.coalesce(shown, F.lit(False))).alias("hidden"))


def select_nodes_by_edge_property(nodes: DataFrame, edges: DataFrame, prop: str, values: Sequence,
                                  node: str = "node", a: str = "start", b: str = "end") -> DataFrame:
    """All nodes, with their columns, and a ``hidden`` flag: shown iff an edge
    with ``prop`` in ``values`` touches it (both endpoints), in one left join."""
    vals = _matchable(values)
    hit = edges.where(F.col(prop).isin(vals) if vals else F.lit(False))
    ends = hit.select(F.explode(F.array(F.col(a), F.col(b))).alias(node)).distinct().withColumn("_hit", F.lit(True))
    return nodes.join(ends, node, "left").select(*nodes.columns, F.col("_hit").isNull().alias("hidden"))


def property_select(nodes: DataFrame, edges: DataFrame, item: str, prop: str, values: Sequence,
                    node: str = "node", a: str = "start", b: str = "end") -> DataFrame:
    """Nodes with a ``hidden`` flag, selected by a node property
    (``item='node'``) or by an edge property on both endpoints (``'edge'``)."""
    if item == "node":
        return select_nodes_by_property(nodes, prop, values, node)
    if item == "edge":
        return select_nodes_by_edge_property(nodes, edges, prop, values, node, a, b)
    raise ValueError(f"unknown item {item!r}")


# ---------------------------------------------------------------- L04
def node_sample(terms: DataFrame, col: str = "term", n: int = 1000) -> DataFrame:
    """The first ``n`` terms in code-point order as numbered, labelled nodes
    (the top-n keeps at most ``n`` rows per task)."""
    top = terms.select(F.col(col).alias("label")).orderBy("label").limit(n)
    return top.select(F.row_number().over(Window.orderBy("label")).alias("node_id"), "label")
