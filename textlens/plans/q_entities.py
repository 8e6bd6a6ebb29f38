"""Queries for span merging, vocabulary and term lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import entities as E
from textlens.plans.fixtures import view, with_views
from textlens.plans.registry import query

_W01_CTES = """
m AS (SELECT *, CASE WHEN lag(span_end) OVER w IS NULL OR span_start <> lag(span_end) OVER w THEN 1 ELSE 0 END
             AS brk FROM v_spans WINDOW w AS (PARTITION BY doc_id ORDER BY span_start, span_end)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY span_start, span_end ROWS UNBOUNDED PRECEDING) AS isl
      FROM m),
g AS (SELECT doc_id, isl, list_reduce(list(score ORDER BY span_start), lambda a, b: a + b) / count(*) AS ms,
             count(*) AS np, string_agg(replace(word, '##', ''), ' ' ORDER BY span_start) AS phrase
      FROM i GROUP BY doc_id, isl),
ph AS (SELECT doc_id, phrase, max(ms) AS score FROM g
       WHERE ms > 0.85 AND np <= 3 AND length(phrase) BETWEEN 3 AND 40 GROUP BY doc_id, phrase)"""


def phrases(spark, sf):
    return E.merge_spans(view(spark, sf, "v_spans"))


@query("w01_merge_spans", with_views("WITH" + _W01_CTES + "\nSELECT doc_id, phrase, round(score, 6) AS score FROM ph",
                                     "v_spans"))
def w01(spark, sf):
    return phrases(spark, sf).select("doc_id", "phrase", F.round("score", 6).alias("score"))


@query("l01_sorted_vocab", with_views("WITH" + _W01_CTES + "\nSELECT DISTINCT phrase AS term FROM ph ORDER BY term",
                                      "v_spans"))
def l01(spark, sf):
    return E.sorted_vocab(phrases(spark, sf))


@query("l01_numbered_vocab", with_views("WITH" + _W01_CTES + """
SELECT row_number() OVER (ORDER BY term) AS id, term FROM (SELECT DISTINCT phrase AS term FROM ph) t
""", "v_spans"))
def l01_numbered(spark, sf):
    return E.numbered_vocab(phrases(spark, sf))


@query("j01_lookup_explanations", with_views("WITH" + _W01_CTES + """,
e AS (SELECT word AS entity FROM v_spans UNION SELECT phrase FROM ph),
cf AS (SELECT lower(term) AS k, arg_min(explanation, term) AS explanation FROM v_terms GROUP BY 1)
SELECT e.entity, coalesce(cf.explanation, '[UNK]') AS explanation, coalesce(t.explanation, '[UNK]') AS explanation_exact
FROM e LEFT JOIN cf ON lower(e.entity) = cf.k LEFT JOIN v_terms t ON lower(e.entity) = t.term
""", "v_spans", "v_terms"))
def j01(spark, sf):
    words = view(spark, sf, "v_spans").select(F.col("word").alias("entity"))
    ents = words.unionByName(phrases(spark, sf).select(F.col("phrase").alias("entity"))).distinct()
    terms = view(spark, sf, "v_terms")
    a = E.lookup_explanations(ents, terms, mode="casefold")
    return E.lookup_explanations(a, terms, mode="exact", out_col="explanation_exact")


@query("j07_insert_ignore", with_views("""
WITH n AS (SELECT word AS term, word || ' @' || CAST(doc_id AS VARCHAR) AS explanation,
                  row_number() OVER (PARTITION BY word ORDER BY doc_id, span_start) AS rn FROM v_spans)
SELECT term, explanation FROM v_terms
UNION ALL SELECT term, explanation FROM n WHERE rn = 1 AND term NOT IN (SELECT term FROM v_terms)
""", "v_spans", "v_terms"))
def j07(spark, sf):
    sp = view(spark, sf, "v_spans")
    new = sp.select(F.col("word").alias("term"),
                    F.concat("word", F.lit(" @"), F.col("doc_id").cast("string")).alias("explanation"),
                    "doc_id", "span_start")
    return E.insert_ignore(view(spark, sf, "v_terms"), new, "term", ["doc_id", "span_start"])


@query("p15_entity_slots", with_views("WITH" + _W01_CTES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rk FROM ph),
ti AS (SELECT lower(term) AS k, arg_min(explanation, term) AS explanation FROM v_terms GROUP BY 1),
x AS (SELECT r.doc_id, r.rk, r.phrase, coalesce(ti.explanation, '[UNK]') AS ex
      FROM r LEFT JOIN ti ON lower(r.phrase) = ti.k WHERE r.rk <= 5),
a AS (SELECT doc_id, list(phrase ORDER BY rk) AS ps, list(ex ORDER BY rk) AS xs FROM x GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id FROM v_spans)
SELECT d.doc_id, array_to_string(list_resize(coalesce(a.ps, []::VARCHAR[]), 5, ''), ' | ') AS entities,
       array_to_string(list_resize(coalesce(a.xs, []::VARCHAR[]), 5, ''), ' | ') AS explanations,
       coalesce(len(a.ps), 0) AS n_valid
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
""", "v_spans", "v_terms"))
def p15(spark, sf):
    sp = view(spark, sf, "v_spans")
    s = E.entity_slots(sp, E.merge_spans(sp), view(spark, sf, "v_terms"))
    return s.select("doc_id", F.array_join("entities", " | ").alias("entities"),
                    F.array_join("explanations", " | ").alias("explanations"),
                    F.aggregate("valid", F.lit(0), lambda a, x: a + x).alias("n_valid"))
