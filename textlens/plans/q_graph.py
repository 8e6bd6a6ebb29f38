"""Queries for the concept graph.

Graph binding: edges come from ``v_edges``; a supplier concept is labelled by
its nation's name and a part concept by its part name, so several concepts
share one label and W02's choice is not trivial.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import graph as G
from textlens.operators.prep import GRAPH_RELATIONS
from textlens.plans.fixtures import table, view, with_views
from textlens.plans.registry import query


def labels(spark, sf):
    sup = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a = sup.select(F.col("n_name").alias("text"), F.lit("en").alias("lang"),
                   F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("concept"))
    b = table(spark, sf, "part").select(F.col("p_name").alias("text"), F.lit("en").alias("lang"),
                                        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("concept"))
    return a.unionByName(b)


def edges(spark, sf):
    return G.edges_from(view(spark, sf, "v_edges"))


_CTES = """
labels AS (SELECT n.n_name AS text, 'en' AS lang, 'S' || CAST(s.s_suppkey AS VARCHAR) AS concept
           FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
           UNION ALL SELECT p_name, 'en', 'P' || CAST(p_partkey AS VARCHAR) FROM part),
edges AS (SELECT src AS start, rel AS relation, dst AS "end", '/a/[/r/' || rel || '/,' || src || ',' || dst || '/]' AS uri
          FROM v_edges),
deg AS (SELECT start AS concept, count(*) AS n_edges FROM edges GROUP BY start),
w2 AS (SELECT text, lang, concept, n_edges FROM (
         SELECT l.text, l.lang, l.concept, coalesce(d.n_edges, 0) AS n_edges,
                row_number() OVER (PARTITION BY l.text, l.lang ORDER BY coalesce(d.n_edges, 0) DESC, l.concept) AS r
         FROM labels l LEFT JOIN deg d ON l.concept = d.concept) t WHERE r = 1)"""

_ALLOWED = ", ".join(f"'{r}'" for r in GRAPH_RELATIONS)


@query("w02_top_concept", with_views("WITH" + _CTES + "\nSELECT * FROM w2", "v_edges"))
def w02(spark, sf):
    return G.top_concept(labels(spark, sf), edges(spark, sf))


J05_ORACLE = with_views("WITH" + _CTES + f""",
e AS (SELECT * FROM edges WHERE relation IN ({_ALLOWED})),
j AS (SELECT w2.text, w2.lang, e.*, row_number() OVER (PARTITION BY w2.text, w2.lang ORDER BY e.uri) AS idx
      FROM w2 JOIN e ON e.start = w2.concept),
el AS (SELECT concept, min(text) AS end_label FROM labels GROUP BY concept)
SELECT j.text AS word, j.lang, j.idx, j.relation, j.start, j."end", el.end_label, j.uri
FROM j LEFT JOIN el ON j."end" = el.concept WHERE idx <= 20
""", "v_edges")


@query("j05_concept_neighbours", J05_ORACLE)
def j05(spark, sf):
    lab = labels(spark, sf)
    return G.concept_neighbours(lab.select("text", "lang"), lab, edges(spark, sf))


@query("j09_two_hop_classes", with_views("WITH" + _CTES + """,
seeds AS (SELECT DISTINCT concept AS seed FROM w2 WHERE n_edges > 0),
sym AS (SELECT start AS u, "end" AS v FROM edges UNION SELECT "end", start FROM edges),
d1 AS (SELECT DISTINCT s.seed, sym.v AS node FROM seeds s JOIN sym ON s.seed = sym.u),
d2 AS (SELECT DISTINCT d1.seed, sym.v AS node FROM d1 JOIN sym ON d1.node = sym.u),
a AS (SELECT seed, seed AS node, 0 AS degree FROM seeds UNION ALL SELECT seed, node, 1 FROM d1
      UNION ALL SELECT seed, node, 2 FROM d2)
SELECT seed, node, min(degree) AS degree,
       CASE min(degree) WHEN 0 THEN 'selected' WHEN 1 THEN 'first' ELSE 'second' END AS class
FROM a GROUP BY seed, node
""", "v_edges"))
def j09(spark, sf):
    e = edges(spark, sf)
    seeds = G.top_concept(labels(spark, sf), e).where(F.col("n_edges") > 0).select(F.col("concept").alias("seed"))
    return G.two_hop_classes(seeds, e)


@query("j10_property_select", with_views("""
WITH edges AS (SELECT src AS start, rel AS relation, dst AS "end" FROM v_edges),
nodes AS (SELECT start AS node FROM edges UNION SELECT "end" FROM edges),
ends AS (SELECT start AS node FROM edges WHERE relation IN ('antonym')
         UNION SELECT "end" FROM edges WHERE relation IN ('antonym'))
SELECT node, node NOT IN (SELECT node FROM ends) AS hidden FROM nodes
""", "v_edges"))
def j10(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("start").alias("node")).unionByName(e.select(F.col("end").alias("node"))).distinct()
    return G.select_nodes_by_edge_property(nodes, e, "relation", ["antonym"])


@query("j10_node_property_select", """
WITH nodes AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS node, p_brand AS grp FROM part)
SELECT node, grp, NOT coalesce(grp IN ('Brand#1', 'Brand#2'), false) AS hidden FROM nodes
""")
def j10_nodes(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"),
                                           F.col("p_brand").alias("grp"))
    return G.select_nodes_by_property(nodes, "grp", ["Brand#1", "Brand#2", "", 0])


@query("l04_node_sample", with_views("""
SELECT row_number() OVER (ORDER BY term) AS node_id, term AS label
FROM (SELECT term FROM v_terms ORDER BY term LIMIT 1000) t
""", "v_terms"))
def l04(spark, sf):
    return G.node_sample(view(spark, sf, "v_terms"))
