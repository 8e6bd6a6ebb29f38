"""Queries for knowledge-base candidates and relation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions.text import WS_RE2
from textlens.operators import kb as KB
from textlens.plans.fixtures import view, with_views
from textlens.plans.registry import query
from textlens.session import scratch_dir


def _terms(spark, sf):
    t = view(spark, sf, "v_terms").select("term")
    words = t.select(F.explode(F.split("term", " ")).alias("term"))
    return t.unionByName(words).distinct()


def _ranked(spark, sf):
    ents = view(spark, sf, "v_entities")
    names = ents.select("qid", F.col("label").alias("name"))
    return KB.rank_candidates(KB.candidate_matches(_terms(spark, sf), names), ents)


def _cands(spark, sf):
    return KB.entity_candidates(_terms(spark, sf), view(spark, sf, "v_entities"), view(spark, sf, "v_entity_props"))


_RANK_CTES = """
tw AS (SELECT term FROM v_terms UNION ALL SELECT unnest(string_split(term, ' ')) FROM v_terms),
t AS (SELECT DISTINCT term FROM tw WHERE length(term) > 0),
m AS (SELECT t.term, e.qid, e.label, coalesce(e.description, '') AS description,
             CAST(e.label = t.term AS INT) AS exact_match, 1 AS label_match,
             CAST(contains(lower(coalesce(e.description, '')), lower(t.term)) AS INT) AS desc_match
      FROM t JOIN v_entities e ON contains(lower(e.label), lower(t.term))),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY exact_match DESC, label_match DESC, desc_match DESC,
                                   qid) AS rank FROM m),
k AS (SELECT * FROM r WHERE rank <= 10)"""

_PL = """
pl AS (SELECT qid, prop, array_to_string(list_sort(list_distinct(list(value))), ' | ') AS vals
       FROM v_entity_props WHERE value IS NOT NULL GROUP BY qid, prop)"""


def _lists(src: str) -> str:
    props = ["P31", "P279", "P527", "P361"]
    cols = ", ".join(f"coalesce({p.lower()}.vals, '') AS {p.lower()}s" for p in props)
    joins = " ".join(f"LEFT JOIN pl {p.lower()} ON {p.lower()}.qid = x.qid AND {p.lower()}.prop = '{p}'"
                     for p in props)
    return f"SELECT x.*, {cols} FROM {src} x {joins}"


@query("j06_name_index", with_views("WITH" + _RANK_CTES + "\nSELECT DISTINCT term, qid, label AS name FROM m", "v_terms", "v_entities"))
def j06_index(spark, sf):
    """Matches from the stored index, built from some names and extended by all."""
    names = view(spark, sf, "v_entities").select("qid", F.col("label").alias("name"))
    index = KB.NameIndex(spark, scratch_dir(spark, "names"), n_buckets=16)
    index.extend(names.where(F.length("name") % 2 == 0))
    index.extend(names)
    return index.search(_terms(spark, sf))


@query("l02_rank_candidates", with_views("WITH" + _RANK_CTES + """
SELECT term, qid, label, description, exact_match, label_match, desc_match, rank FROM k
""", "v_terms", "v_entities"))
def l02(spark, sf):
    return _ranked(spark, sf).select("term", "qid", "label", "description", "exact_match", "label_match",
                                     "desc_match", "rank")


@query("j06_entity_candidates", with_views("WITH" + _RANK_CTES + "," + _PL + f"""
SELECT term, rank, qid, label, description, p31s, p279s, p527s, p361s FROM ({_lists('k')}) z
""", "v_terms", "v_entities", "v_entity_props"))
def j06(spark, sf):
    return _cands(spark, sf)


@query("a09_explanation_text", with_views("WITH" + _RANK_CTES + """
SELECT term, string_agg(term || ', ' || description, chr(10) ORDER BY rank) AS explanation FROM k GROUP BY term
""", "v_terms", "v_entities"))
def a09(spark, sf):
    return KB.explanation_text(_ranked(spark, sf))


@query("a07_grouped_distinct_concat", with_views("WITH" + _PL + "\nSELECT qid, prop, vals FROM pl",
                                                 "v_entity_props"))
def a07(spark, sf):
    return KB.grouped_distinct_concat(view(spark, sf, "v_entity_props"), ["qid", "prop"], "value")


_CONFIG = ", ".join(f"('{p.lower()}s', '{lab}', {w}, {i})" for i, (p, lab, w) in enumerate(KB.RELATION_CONFIG))
_STRIP = rf"regexp_replace(value, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


@query("a08_relation_importance", with_views("WITH" + _PL + f""",
lists AS ({_lists('(SELECT qid FROM v_entities)')}),
long AS (SELECT qid, 'p31s' AS c, p31s AS v FROM lists UNION ALL SELECT qid, 'p279s', p279s FROM lists
         UNION ALL SELECT qid, 'p527s', p527s FROM lists UNION ALL SELECT qid, 'p361s', p361s FROM lists),
cfg AS (SELECT c, relation, CAST(weight AS DOUBLE) AS weight, ci FROM (VALUES {_CONFIG})
        t(c, relation, weight, ci)),
sp AS (SELECT long.qid, cfg.relation, cfg.weight, cfg.ci, string_split(long.v, ' | ') AS parts
       FROM long JOIN cfg ON long.c = cfg.c WHERE long.v <> ''),
vals AS (SELECT qid, relation, weight, ci, unnest(parts) AS value, unnest(generate_series(1, len(parts))) AS pos
         FROM sp)
SELECT l.qid, round(coalesce(sum(v.weight), 0.0), 2) AS importance_score, count(v.value) AS n_relations,
       coalesce(string_agg(v.relation || '=' || {_STRIP.replace('value', 'v.value')}, '; '
                           ORDER BY v.weight DESC, v.ci, v.pos), '') AS relations
FROM lists l LEFT JOIN vals v ON l.qid = v.qid GROUP BY l.qid
""", "v_entities", "v_entity_props"))
def a08(spark, sf):
    ents = view(spark, sf, "v_entities").select("qid")
    f10 = ents.join(KB.property_lists(view(spark, sf, "v_entity_props")), "qid", "left").select(
        "qid", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("p31s", "p279s", "p527s", "p361s")])
    r = KB.relation_importance(f10)
    return r.select("qid", F.round("importance_score", 2).alias("importance_score"),
                    F.size("relations").alias("n_relations"),
                    F.array_join(F.transform("relations", lambda x: F.concat(x["relation"], F.lit("="), x["value"])),
                                 "; ").alias("relations"))
