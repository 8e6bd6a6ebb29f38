"""Queries for vectors, scoring and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions.text import WS_RE2
from textlens.operators import scoring as S
from textlens.operators import vectors as V
from textlens.plans.fixtures import fresh, table
from textlens.plans.registry import query

_DOT = ("list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))")
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("j08_cosine_pairs", f"""
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       round({_DOT.format(a='a.embedding', b='b.embedding')} /
             ({_NORM.format(a='a.embedding')} * {_NORM.format(a='b.embedding')}), 6) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def j08(spark, sf):
    e = table(spark, sf, "embeddings")
    out = V.cosine_pairs(e, V.successor_pairs(e))
    return out.select("left_id", "right_id", F.round("cosine", 6).alias("cosine"))


@query("j08_top_k_cosine", f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
       {_DOT.format(a='a.embedding', b='b.embedding')} /
         ({_NORM.format(a='a.embedding')} * {_NORM.format(a='b.embedding')}) AS cosine
     FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM p)
SELECT query_id, rank, id, round(cosine, 6) + 0.0 AS cosine FROM r WHERE rank <= 5
""")
def j08_top(spark, sf):
    e = table(spark, sf, "embeddings")
    out = V.top_k_cosine(e, e.where("vec_id % 10 = 0"), 5)
    return out.select("query_id", "rank", "id", F.round("cosine", 6).alias("cosine"))


# Token matrices sliced out of each embedding: 8 token vectors of 8 values,
# of which the first (vec_id % 8) + 1 are real tokens.
@query("m02_pool_features", """
WITH t AS (SELECT vec_id, embedding, CAST(vec_id % 8 AS INTEGER) AS last_idx FROM embeddings)
SELECT vec_id, last_idx AS idx,
       round(list_sum(list_transform(embedding[last_idx * 8 + 1: last_idx * 8 + 8], lambda x: x::DOUBLE)), 6) + 0.0
         AS p_sum,
       round(embedding[last_idx * 8 + 1]::DOUBLE, 6) + 0.0 AS p_first
FROM t
""")
def m02(spark, sf):
    e = table(spark, sf, "embeddings")
    t = V.token_matrix(e, "embedding", 8)
    n_real = (F.col("vec_id") % 8 + 1).cast("int")
    t = t.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), 8 - n_real)))
    p = V.pool_features(t, how="last")
    return p.select("vec_id", (n_real - 1).alias("idx"),
                    F.round(F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("p_sum"),
                    F.round(F.get("pooled", 0).cast("double"), 6).alias("p_first"))


@query("m03_fuse_features", """
SELECT vec_id, len(embedding) + 2 AS dim,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + label + len(embedding), 6) + 0.0 AS vsum
FROM embeddings
""")
def m03(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("dim_in", F.size("embedding").cast("double"))
    f = V.fuse_features(e, ["embedding", "label", "dim_in"])
    s = V.vector_summary(f)
    return s.select("vec_id", "dim", F.round("vsum", 6).alias("vsum"))


def _p_sql(t: str) -> str:
    z = f"((5 * (length({t}) - length(regexp_replace({t}, '[aeiou]', '', 'g'))) - 2 * length({t})) / 100.0)"
    return f"(exp({z} - greatest({z}, 0.0)) / (exp(-greatest({z}, 0.0)) + exp({z} - greatest({z}, 0.0))))"


@query("m01_score_texts", f"""
SELECT doc_id, round({_p_sql('text')}, 6) AS p_positive,
       CASE WHEN (5 * (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) - 2 * length(text)) > 0
            THEN 1 ELSE 0 END AS prediction, CASE WHEN text IS NULL THEN 'missing text' END AS error
FROM documents
""")
def m01(spark, sf):
    d = fresh(spark, sf, "documents")
    s = S.score_texts(d, S.vowel_length_predictor, "text", keep=["doc_id"], dedupe=True)
    return s.select("doc_id", F.round("p_positive", 6).alias("p_positive"), "prediction", "error")


_TOKS = rf"list_filter(regexp_split_to_array(text, '{WS_RE2}+'), lambda x: x <> '')"


@query("m07_token_attribution", f"""
WITH u AS (SELECT conv_id, turn, {_TOKS} AS toks FROM conversations),
x AS (SELECT conv_id, turn, toks, unnest(generate_series(1, len(toks))) AS i FROM u),
v AS (SELECT conv_id, turn, i - 1 AS pos, toks[i] AS token, array_to_string(toks, ' ') AS full_text,
             array_to_string(list_concat(toks[1:i - 1], toks[i + 1:]), ' ') AS variant FROM x),
w AS (SELECT conv_id, turn, pos, token, {_p_sql('full_text')} - {_p_sql('variant')} AS weight FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(abs(weight), 9) DESC, pos) AS rank
      FROM w)
SELECT conv_id, turn, pos, token, round(weight, 6) + 0.0 AS weight, rank FROM r WHERE rank <= 10
""")
def m07(spark, sf):
    c = fresh(spark, sf, "conversations")
    a = S.loo_attribution(c, S.vowel_length_predictor, ["conv_id", "turn"], "text", k=10)
    return a.select("conv_id", "turn", "pos", "token", F.round("weight", 6).alias("weight"), "rank")


# A predictor that only looks for one word: that word must come out first.
@query("m07_sampled_attribution", f"""
SELECT conv_id, turn, 1 AS rank, len({_TOKS}) AS pos, 'zzmark' AS token, true AS raises FROM conversations
""")
def m07s(spark, sf):
    c = fresh(spark, sf, "conversations").withColumn("text", F.concat_ws(" ", "text", F.lit("zzmark")))
    out = S.sampled_attribution(c, S.marker_predictor, ["conv_id", "turn"], "text", n_samples=64, k=10)
    return out.where("rank = 1").select("conv_id", "turn", "rank", F.col("pos").cast("long"), "token",
                                        (F.col("weight") > 0).alias("raises"))
