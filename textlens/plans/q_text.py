"""Queries for corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions import wordpiece as WP
from textlens.functions.text import NOT_WS_RE2, WS_RE2
from textlens.operators import prep as P
from textlens.operators import scoring as S
from textlens.plans.fixtures import fresh, table, view, with_views
from textlens.plans.prefix import dense_ranks
from textlens.plans.registry import query


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def _toks(e: str) -> str:
    return rf"list_filter(regexp_split_to_array({e}, '{WS_RE2}+'), lambda x: x <> '')"


# ---------------------------------------------------------------- P01 + P02
@query("p01_dialogue_text", with_views("""
SELECT conv_id,
       coalesce(string_agg(CASE WHEN NOT is_response THEN text END, ' ' ORDER BY turn), '') || ' '
         || max(CASE WHEN is_response THEN text END) AS text,
       CASE WHEN max(label) = 'SARCASM' THEN 1 ELSE 0 END AS label
FROM v_dialog_turns GROUP BY conv_id
""", "v_dialog_turns"))
def p01(spark, sf):
    return P.dialogues_from_turns(view(spark, sf, "v_dialog_turns"))


@query("p02_binarize_label", with_views("""
SELECT conv_id, turn, label, CASE WHEN label = 'SARCASM' THEN 1 ELSE 0 END AS label_int FROM v_dialog_turns
""", "v_dialog_turns"))
def p02(spark, sf):
    t = view(spark, sf, "v_dialog_turns")
    return t.select("conv_id", "turn", "label", P.binarize_label("label").alias("label_int"))


# ---------------------------------------------------------------- P03 + P04
def _clean_sql(e: str) -> str:
    e = rf"regexp_replace({e}, '[@#][\p{{L}}\p{{N}}_]+', '', 'g')"
    e = rf"regexp_replace({e}, 'http{NOT_WS_RE2}+', '', 'g')"
    e = (rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}\-''?.!]', '', 'g')")
    e = rf"regexp_replace({e}, '{WS_RE2}+', ' ', 'g')"
    return _strip(e)


@query("p03_clean_text", with_views(f"""
SELECT doc_id, text FROM (SELECT doc_id, {_clean_sql('text')} AS text FROM v_social WHERE text IS NOT NULL) c
WHERE text <> ''
""", "v_social"))
def p03(spark, sf):
    return P.clean_texts(fresh(spark, sf, "v_social"))


# ---------------------------------------------------------------- P05
_FLAGS = ",\n".join(
    "  CASE WHEN label IN (" + ", ".join(f"'{x}'" for x in group) + f") AND score > {P.EMOTION_THRESHOLD} THEN 1 ELSE 0 END"
    f" AS {name}" for name, group in P.EMOTION_GROUPS.items())


@query("p05_emotion_flags", with_views(f"""
SELECT doc_id, label, score,
{_FLAGS}
FROM v_emotion
""", "v_emotion"))
def p05(spark, sf):
    return P.emotion_flags(view(spark, sf, "v_emotion"))


# ---------------------------------------------------------------- P06
_TASKS = ["sarcasm", "hostile", "contempt", "humor"]


@query("p06_label_vector", with_views("""
WITH w AS (SELECT doc_id, max(CASE WHEN task = 'sarcasm' THEN y END) AS sarcasm_label,
                  max(CASE WHEN task = 'hostile' THEN y END) AS hostile_label,
                  max(CASE WHEN task = 'contempt' THEN y END) AS contempt_label,
                  max(CASE WHEN task = 'humor' THEN y END) AS humor_label
           FROM v_pred_long GROUP BY doc_id)
SELECT doc_id, concat_ws(',', CAST(sarcasm_label AS VARCHAR), CAST(hostile_label AS VARCHAR),
                         CAST(contempt_label AS VARCHAR), CAST(humor_label AS VARCHAR)) AS labels,
       sarcasm_label, hostile_label, contempt_label, humor_label FROM w
""", "v_pred_long"))
def p06(spark, sf):
    wide = view(spark, sf, "v_pred_long").groupBy("doc_id").pivot("task", _TASKS).agg(F.max("y"))
    packed = P.label_vector(wide, _TASKS).select("doc_id", "labels")
    names = [f"{t}_label" for t in _TASKS]
    out = P.split_label_vector(packed, names)
    return out.select("doc_id", F.array_join("labels", ",").alias("labels"), *names)


# ---------------------------------------------------------------- P07
@query("p07_relation_filter", with_views("""
SELECT src, rel, dst FROM v_edges
WHERE rel IN ('antonym', 'related_to', 'synonym', 'is_a', 'has_a', 'part_of', 'used_for',
              'causes', 'has_property', 'at_location', 'form_of')
""", "v_edges"))
def p07(spark, sf):
    return P.relation_filter(view(spark, sf, "v_edges"))


# ---------------------------------------------------------------- P08
_P08_INPUT = "SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE label END AS label FROM v_text"


@query("p08_validate_required", with_views(f"""
WITH x AS ({_P08_INPUT})
SELECT 'text' AS field, true AS present, true AS type_ok, count(*) FILTER (WHERE text IS NULL) AS n_null FROM x
UNION ALL SELECT 'label', true, true, count(*) FILTER (WHERE label IS NULL) FROM x
UNION ALL SELECT 'knowledge_features', false, false, CAST(NULL AS BIGINT)
""", "v_text"))
def p08(spark, sf):
    v = view(spark, sf, "v_text")
    x = v.select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("label"))
                 .cast("int").alias("label"))
    return P.validate_required(x, ["text", "label", "knowledge_features"], types={"label": "int"})


@query("p08_invalid_rows", with_views("""
SELECT 'text' AS field, doc_id, 'missing' AS problem FROM v_corpus WHERE text IS NULL
UNION ALL SELECT 'label', doc_id, 'missing' FROM v_corpus WHERE label IS NULL
UNION ALL SELECT 'lang', doc_id, CASE WHEN lang IS NULL THEN 'missing' ELSE 'bad type' END FROM v_corpus
UNION ALL SELECT 'knowledge_features', doc_id, 'missing' FROM v_corpus
""", "v_corpus"))
def p08_rows(spark, sf):
    v = view(spark, sf, "v_corpus")
    bad = P.invalid_rows(v, ["text", "label", "lang", "knowledge_features"], ["doc_id"], types={"lang": "int"})
    return bad.select("field", F.get_json_object("item", "$.doc_id").cast("long").alias("doc_id"), "problem")


# ---------------------------------------------------------------- P09
@query("p09_quarantine_rows", """
WITH x AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN json_extract_string(props, '$.k') || 'x'
                        WHEN event_id % 13 = 0 THEN ' ' || json_extract_string(props, '$.k') || ' '
                        WHEN event_id % 17 = 0 THEN NULL
                        ELSE json_extract_string(props, '$.k') END AS k FROM events)
SELECT event_id, CASE WHEN regexp_full_match(k, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(k) AS INTEGER) END AS k,
       k IS NOT NULL AND NOT coalesce(regexp_full_match(k, '\\s*[+-]?[0-9]+\\s*'), false) AS is_bad
FROM x
""".replace("\\\\", "\\"))
def p09(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.get_json_object("props", "$.k")
    x = ev.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(raw, F.lit("x")))
                  .when(F.col("event_id") % 13 == 0, F.concat(F.lit(" "), raw, F.lit(" ")))
                  .when(F.col("event_id") % 17 == 0, F.lit(None).cast("string"))
                  .otherwise(raw).alias("k"))
    good, bad = P.quarantine_rows(x, {"k": "int"})
    return good.select("event_id", "k", F.lit(False).alias("is_bad")).unionByName(
        bad.select("event_id", "k", F.lit(True).alias("is_bad")))


# ---------------------------------------------------------------- P10
PROMPT = "Decide whether the text is sarcastic. Reply 1 for sarcastic, 0 otherwise.\nText: {text}\nLanguage: {lang}"


@query("p10_render_prompt", with_views("""
SELECT doc_id, 'Decide whether the text is sarcastic. Reply 1 for sarcastic, 0 otherwise.' || chr(10) || 'Text: '
       || coalesce(text, '') || chr(10) || 'Language: ' || coalesce(lang, '') AS prompt FROM v_corpus
""", "v_corpus"))
def p10(spark, sf):
    v = view(spark, sf, "v_corpus")
    return v.select("doc_id", P.render_prompt(PROMPT, text=F.coalesce("text", F.lit("")),
                                              lang=F.coalesce("lang", F.lit(""))).alias("prompt"))


# ---------------------------------------------------------------- P11
_ANSWERS = """CASE doc_id % 5 WHEN 0 THEN ' 1 ' WHEN 1 THEN '0' WHEN 2 THEN substr(text, 1, 3)
                    WHEN 3 THEN '1' || chr(10) ELSE NULL END"""


@query("p11_parse_binary_answer", f"""
WITH a AS (SELECT doc_id, {_strip(_ANSWERS)} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '1' THEN 1 ELSE 0 END AS value, coalesce(s IN ('0', '1'), false) AS valid FROM a
""")
def p11(spark, sf):
    d = table(spark, sf, "documents")
    ans = F.expr(_ANSWERS.replace("chr(10)", "char(10)"))
    r = d.select("doc_id", P.parse_binary_answer(ans).alias("a"))
    return r.select("doc_id", "a.value", "a.valid")


# ---------------------------------------------------------------- P12
@query("p12_keyword_answer", """
SELECT doc_id, CASE WHEN contains(lower(text), 'yes') OR contains(lower(text), 'sarcastic') THEN 'yes' ELSE 'no' END
       AS answer FROM documents
""")
def p12(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.keyword_answer("text").alias("answer"))


# ---------------------------------------------------------------- P13
_REQ = ("the", "and", "of")


@query("p13_validate_explanation", f"""
SELECT doc_id, CASE WHEN {' AND '.join(f"contains(lower(text), '{k}')" for k in _REQ)} THEN
  array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}),
                              lambda l: l <> ''), chr(10)) END AS explanation
FROM documents
""")
def p13(spark, sf):
    d = fresh(spark, sf, "documents")
    return d.select("doc_id", P.validate_explanation("text", _REQ).alias("explanation"))


# ---------------------------------------------------------------- P14
@query("p14_token_window", with_views(f"""
WITH t AS (SELECT doc_id, list_slice({_toks('text')}, 1, 128) AS toks FROM v_corpus)
SELECT doc_id, array_to_string(list_resize(toks, 128, '[PAD]'), ' ') AS tokens, len(toks) AS n_real,
       128 AS width FROM t
""", "v_corpus"))
def p14(spark, sf):
    w = P.token_window(fresh(spark, sf, "v_corpus"), "text", 128)
    return w.select("doc_id", F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.size("attention_mask").alias("width"))


@query("p14_longest_window", f"""
WITH t AS (SELECT conv_id, turn, list_slice({_toks('text')}, 1, 128) AS toks FROM conversations),
w AS (SELECT max(len(toks)) AS width FROM t)
SELECT conv_id, turn, array_to_string(list_resize(toks, width, '[PAD]'), ' ') AS tokens, len(toks) AS n_real, width
FROM t, w
""")
def p14_longest(spark, sf):
    w = P.token_window(table(spark, sf, "conversations"), "text", 128, pad="longest")
    return w.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.size("attention_mask").alias("width"))


def _length_tokenizer():
    """Deterministic toy tokenizer: a word's id is its length."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


@query("p14_subword_ids", f"""
WITH t AS (SELECT conv_id, turn, list_slice(list_transform({_toks('text')}, lambda w: length(w)), 1, 32) AS ids
           FROM conversations)
SELECT conv_id, turn, array_to_string(list_resize(ids, 32, 0), ' ') AS input_ids, len(ids) AS n_real FROM t
""")
def p14_subword(spark, sf):
    e = S.encode_texts(table(spark, sf, "conversations"), _length_tokenizer, keep=["conv_id", "turn"], max_length=32)
    return e.select("conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


# The vocabulary: words of the term table, letters and a few endings, numbered in order.
_PIECES = """
SELECT DISTINCT unnest(string_split(lower(term), ' ')) AS token FROM v_terms
UNION SELECT chr(CAST(i AS INTEGER)) FROM generate_series(97, 122) t(i)
UNION SELECT '##' || chr(CAST(i AS INTEGER)) FROM generate_series(97, 118) t(i)
UNION SELECT unnest(['##er', '##en', '##ing', '##es', '##tion', 'th', 'the', 're', 'un', '##.', '##,'])"""


@query("p14_word_pieces", with_views(f"""
WITH p AS ({_PIECES}),
v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM p WHERE token <> ''),
first AS (SELECT token AS t, id FROM v WHERE NOT starts_with(token, '##')),
rest AS (SELECT substr(token, 3) AS t, id FROM v WHERE starts_with(token, '##')),
w AS (SELECT conv_id, turn, unnest({_toks('lower(text)')}) AS word, generate_subscripts({_toks('lower(text)')}, 1) AS k FROM conversations),
step AS (
  SELECT word, 0 AS pos, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT word FROM w WHERE length(word) <= 100) d
  UNION ALL
  SELECT s.word, s.pos + max(length(x.t)), list_append(any_value(s.ids), arg_max(x.id, length(x.t)))
  FROM step s JOIN (SELECT true AS whole, t, id FROM first UNION ALL SELECT false, t, id FROM rest) x
    ON x.whole = (s.pos = 0) AND substr(s.word, s.pos + 1, length(x.t)) = x.t AND s.pos < length(s.word)
  GROUP BY s.word, s.pos),
done AS (SELECT word, ids FROM step WHERE pos = length(word)),
e AS (SELECT conv_id, turn, flatten(list(coalesce(ids, [0]) ORDER BY k)) AS ids FROM w LEFT JOIN done USING (word) GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, array_to_string(list_resize(list_slice(coalesce(ids, []), 1, 64), 64, 0), ' ') AS input_ids,
       least(64, len(coalesce(ids, []))) AS n_real
FROM conversations c LEFT JOIN e USING (conv_id, turn)
""", "v_terms").replace("WITH", "WITH RECURSIVE", 1))
def p14_pieces(spark, sf):
    words = view(spark, sf, "v_terms").select(F.explode(F.split(F.lower("term"), " ")).alias("token"))
    fixed = [chr(i) for i in range(97, 123)] + [f"##{chr(i)}" for i in range(97, 119)]
    fixed += ["##er", "##en", "##ing", "##es", "##tion", "th", "the", "re", "un", "##.", "##,"]
    tokens = words.union(spark.createDataFrame([(t,) for t in fixed], "token string")).where("token <> ''").distinct()
    vocab = WP.vocabulary(dense_ranks(tokens, "token", "id")) | {"[UNK]": 0}
    e = S.encode_texts(table(spark, sf, "conversations"), WP.word_pieces(vocab), keep=["conv_id", "turn"], max_length=64)
    return e.select("conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


# ---------------------------------------------------------------- M08
_M08 = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rk <= ceil(n * 2 / 10) THEN 'test' ELSE 'train' END AS split FROM r
"""


@query("m08_exact_split", _M08)
def m08(spark, sf):
    return P.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 42)


# ---------------------------------------------------------------- U01 / A13
# Three corpora; only the headlines are split here, the others arrive split.
_GIVEN = "CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END"


def _corpora(spark, sf):
    v = view(spark, sf, "v_corpus").select("doc_id", "text", "label", "lang", F.expr(_GIVEN).alias("split"))
    lang = F.coalesce("lang", F.lit(""))
    return {
        "headlines": v.where(lang == "en").drop("split"),
        "forum": v.where(lang.isin("fr", "es")),
        "micro": v.where(~lang.isin("en", "fr", "es")),
    }


_U01_SRC = f"""
u AS (SELECT CASE WHEN lang = 'en' THEN 'headlines' WHEN lang IN ('fr', 'es') THEN 'forum' ELSE 'micro' END AS dataset,
             doc_id, text, label, {_GIVEN} AS given FROM v_corpus)"""


@query("u01_union_datasets", with_views(f"""
WITH {_U01_SRC}
SELECT dataset, doc_id, text, label FROM (SELECT dataset, doc_id, {_clean_sql('text')} AS text, label FROM u
  WHERE text IS NOT NULL) c WHERE text <> ''
""", "v_corpus"))
def u01(spark, sf):
    u = P.union_datasets(_corpora(spark, sf))
    return P.clean_texts(u).select("dataset", "doc_id", "text", "label")


@query("a13_split_sizes", with_views(f"""
WITH {_U01_SRC},
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk,
             count(*) OVER (PARTITION BY dataset) AS n FROM u)
SELECT dataset, CASE WHEN dataset <> 'headlines' THEN given WHEN rk <= ceil(n * 2 / 10) THEN 'test' ELSE 'train' END
         AS split, count(*) AS n_rows
FROM r GROUP BY 1, 2
""", "v_corpus"))
def a13(spark, sf):
    c = {name: f.select("doc_id", *[x for x in f.columns if x == "split"]) for name, f in _corpora(spark, sf).items()}
    c["headlines"] = P.exact_split(c["headlines"], "doc_id", 0.2, 42)
    return P.split_sizes(P.union_datasets(c))


# ---------------------------------------------------------------- J11
@query("j11_align_predictions", with_views("""
SELECT t.doc_id, t.lang, t.label, p.y, p.p, p.yhat FROM v_text t JOIN v_pred p ON t.doc_id = p.doc_id
""", "v_text", "v_pred"))
def j11(spark, sf):
    src = view(spark, sf, "v_text").select("doc_id", "lang", "label")
    return P.align_predictions(src, view(spark, sf, "v_pred"), "doc_id")


@query("j11_alignment_report", with_views("""
WITH s AS (SELECT doc_id, count(*) AS ns FROM documents GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS np FROM v_pred GROUP BY doc_id
      UNION ALL SELECT doc_id, 1 FROM v_pred WHERE p > 0.9),
pp AS (SELECT doc_id, sum(np) AS np FROM p GROUP BY doc_id),
j AS (SELECT s.ns, pp.np FROM s FULL OUTER JOIN pp ON s.doc_id = pp.doc_id)
SELECT count(ns) AS n_src_ids, count(np) AS n_pred_ids, count(*) FILTER (WHERE ns IS NOT NULL AND np IS NOT NULL)
       AS n_matched, count(*) FILTER (WHERE np > 1) AS n_dup_pred,
       count(*) FILTER (WHERE ns IS NOT NULL AND np IS NULL) AS n_missing, count(*) FILTER (WHERE ns IS NULL)
       AS n_orphan_pred FROM j
""", "v_pred"))
def j11_report(spark, sf):
    # All documents against the predictions, which exist for labelled
    # documents only (gaps), with confident predictions submitted twice
    # (duplicates), as a misaligned batch would give.
    pred = view(spark, sf, "v_pred")
    pred = pred.unionByName(pred.where(F.col("p") > 0.9))
    return P.alignment_report(table(spark, sf, "documents").select("doc_id"), pred, "doc_id")
