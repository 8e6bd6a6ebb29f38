"""Queries for J02, J03, J04, A10 over ``v_social`` and the dictionary views."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions.text import WS_RE2
from textlens.operators import knowledge as K
from textlens.plans.fixtures import fresh, view, with_views
from textlens.plans.registry import query

_NORM = rf"regexp_replace(lower(text), '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"
_TOKS = rf"list_filter(regexp_split_to_array({_NORM}, '{WS_RE2}+'), lambda x: x <> '')"

_J02 = with_views(f"""
WITH toks AS (SELECT doc_id, unnest({_TOKS}) AS tok FROM v_social),
hits AS (SELECT t.doc_id, sum(l.positive) AS p, sum(l.negative) AS n
         FROM toks t JOIN v_lexicon l ON t.tok = l.word GROUP BY t.doc_id)
SELECT s.doc_id, round(coalesce(h.p, 0.0), 6) AS positive, round(coalesce(h.n, 0.0), 6) AS negative
FROM v_social s LEFT JOIN hits h ON s.doc_id = h.doc_id
""", "v_social", "v_lexicon")


@query("j02_lexicon_sentiment", _J02)
def j02(spark, sf):
    out = K.lexicon_sentiment(fresh(spark, sf, "v_social"), view(spark, sf, "v_lexicon"))
    return out.select("doc_id", F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative"))


_SLANG_BODY = f"""
WITH t AS (SELECT doc_id, {_TOKS} AS toks FROM v_social),
x AS (SELECT doc_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS i FROM t),
m AS (SELECT x.doc_id, x.i, x.tok, s.expansion FROM x LEFT JOIN v_slang s ON x.tok = s.slang),
agg AS (SELECT doc_id, string_agg(coalesce(expansion, tok), ' ' ORDER BY i) AS expanded,
               count(DISTINCT CASE WHEN expansion IS NOT NULL THEN tok END) AS n_slang
        FROM m GROUP BY doc_id)
"""

_J03 = with_views(_SLANG_BODY + """
SELECT v.doc_id, coalesce(a.expanded, '') AS expanded, coalesce(a.n_slang, 0) AS n_slang
FROM v_social v LEFT JOIN agg a ON v.doc_id = a.doc_id
""", "v_social", "v_slang")


@query("j03_slang_expand", _J03)
def j03(spark, sf):
    out = K.slang_expand(fresh(spark, sf, "v_social"), dict(K.SLANG))
    return out.select("doc_id", "expanded", F.col("n_slang").cast("long").alias("n_slang"))


# Emoji replacement in the oracle: the dictionary rows, longest first.
_EMOJI_ROWS = sorted(K.EMOJI, key=lambda kv: (-len(kv[0]), kv[0]))


def _sql_replace_chain(expr: str) -> str:
    for k, v in _EMOJI_ROWS:
        expr = f"replace({expr}, '{k}', ' {v} ')"
    return expr


def _sql_emoji_count(expr: str) -> str:
    keys = "|".join(k for k, _ in _EMOJI_ROWS)
    return (f"CAST(len(list_distinct(list_filter(regexp_extract_all({expr}, '{keys}'), lambda k: length(k) = 1))) "
            "AS INT)")


_J04 = with_views(f"""
SELECT doc_id, {_sql_replace_chain('text')} AS expanded, {_sql_emoji_count('text')} AS n_emoji
FROM v_social
""", "v_social")


@query("j04_emoji_expand", _J04)
def j04(spark, sf):
    out = K.emoji_expand(fresh(spark, sf, "v_social"), dict(K.EMOJI))
    return out.select("doc_id", "expanded", F.col("n_emoji").cast("int").alias("n_emoji"))


_A10 = with_views(_SLANG_BODY + f""",
toks AS (SELECT doc_id, unnest({_TOKS}) AS tok FROM v_social),
hits AS (SELECT t.doc_id, sum(l.positive) AS p, sum(l.negative) AS n
         FROM toks t JOIN v_lexicon l ON t.tok = l.word GROUP BY t.doc_id)
SELECT v.doc_id, round(coalesce(h.p, 0.0), 6) AS positive, round(coalesce(h.n, 0.0), 6) AS negative,
       coalesce(a.n_slang, 0) AS n_slang, {_sql_emoji_count(_NORM.replace('text', 'v.text'))} AS n_emoji
FROM v_social v LEFT JOIN agg a ON v.doc_id = a.doc_id LEFT JOIN hits h ON v.doc_id = h.doc_id
""", "v_social", "v_slang", "v_emoji", "v_lexicon")


def a10_frame(spark, sf):
    out = K.knowledge_features(fresh(spark, sf, "v_social"), view(spark, sf, "v_lexicon"),
                               dict(K.SLANG), dict(K.EMOJI))
    return out.select("doc_id", F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative"),
                      F.col("n_slang").cast("long").alias("n_slang"), F.col("n_emoji").cast("int").alias("n_emoji"))


query("a10_knowledge_features", _A10)(a10_frame)


_A10P = with_views(_SLANG_BODY + f"""
SELECT v.doc_id, {_sql_replace_chain("coalesce(a.expanded, '')")} AS processed_text
FROM v_social v LEFT JOIN agg a ON v.doc_id = a.doc_id
""", "v_social", "v_slang")


@query("a10_preprocess_text", _A10P)
def a10p(spark, sf):
    out = K.preprocess_text(fresh(spark, sf, "v_social"), dict(K.SLANG), dict(K.EMOJI))
    return out.select("doc_id", "processed_text")
