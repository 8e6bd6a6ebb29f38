"""Queries for sources and sinks.

The driver ships parquet only, so each query first writes its input in the
source format to a fresh folder under the session's shared checkpoint folder
(``spark.checkpoint.dir``), then reads it back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import graph as G
from textlens.operators import metrics as M
from textlens.plans import q_graph, q_kb, q_triples
from textlens.plans.fixtures import view, with_views
from textlens.plans.registry import query
from textlens.session import scratch_dir
from textlens.sources import io as IO


@query("s01_read_headlines", with_views("SELECT text, label FROM v_text", "v_text"))
def s01(spark, sf):
    path = scratch_dir(spark, "headlines")
    v = view(spark, sf, "v_text")
    v.select(F.col("text").alias("headline"), F.col("label").alias("is_sarcastic"),
             F.concat(F.lit("https://example.org/a/"), F.col("doc_id").cast("string")).alias("article_link")
             ).write.json(path)
    return IO.read_headlines(spark, path)


@query("s02_read_dialogues", with_views("""
SELECT coalesce(string_agg(CASE WHEN NOT is_response THEN text END, ' ' ORDER BY turn), '') || ' '
         || max(CASE WHEN is_response THEN text END) AS text,
       CASE WHEN max(label) = 'SARCASM' THEN 1 ELSE 0 END AS label
FROM v_dialog_turns GROUP BY conv_id
""", "v_dialog_turns"))
def s02(spark, sf):
    path = scratch_dir(spark, "dialogues")
    t = view(spark, sf, "v_dialog_turns")
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_response"), F.struct("turn", "text")))).alias("c"),
        F.max(F.when(F.col("is_response"), F.col("text"))).alias("response"), F.max("label").alias("label"))
    g.select(F.transform("c", lambda s: s["text"]).alias("context"), "response", "label").write.json(path)
    return IO.read_dialogues(spark, path)


@query("s03_read_labeled_csv", with_views("SELECT text, label FROM v_text", "v_text"))
def s03(spark, sf):
    path = scratch_dir(spark, "labeled")
    IO.write_labeled_csv(view(spark, sf, "v_text").select("text", "label"), path)
    return IO.read_labeled_csv(spark, path)


_NA_TEXT = """CASE WHEN doc_id % 13 = 0 THEN 'NA' WHEN doc_id % 17 = 0 THEN 'null' WHEN doc_id % 19 = 0 THEN ''
                   WHEN doc_id % 23 = 0 THEN 'None' ELSE text END"""


@query("s04_read_text_column", with_views(f"""
SELECT text FROM (SELECT {_NA_TEXT} AS text FROM v_corpus) t
WHERE text IS NOT NULL AND text NOT IN ({", ".join("'" + x + "'" for x in IO.PANDAS_NA)})
""", "v_corpus"))
def s04(spark, sf):
    path = scratch_dir(spark, "textcol")
    v = view(spark, sf, "v_corpus")
    IO.write_labeled_csv(v.select(F.expr(_NA_TEXT).alias("text"), "label", "lang"), path)
    return IO.read_text_column(spark, path)


@query("s06_term_list_io", with_views("SELECT DISTINCT word AS term FROM v_spans", "v_spans"))
def s06(spark, sf):
    path = scratch_dir(spark, "terms")
    IO.write_terms(view(spark, sf, "v_spans").select(F.col("word").alias("term")), path)
    return IO.read_terms(spark, path)


@query("s07_term_table", with_views("""
WITH n AS (SELECT word AS term, word || ' @' || CAST(doc_id AS VARCHAR) AS explanation,
                  row_number() OVER (PARTITION BY word ORDER BY doc_id, span_start) AS rn FROM v_spans)
SELECT term, explanation FROM v_terms
UNION ALL SELECT term, explanation FROM n WHERE rn = 1 AND term NOT IN (SELECT term FROM v_terms)
""", "v_spans", "v_terms"))
def s07(spark, sf):
    table = IO.TermTable(spark, scratch_dir(spark, "termtable"), n_buckets=8).create_if_missing()
    table.merge_ignore(view(spark, sf, "v_terms").withColumn("_o", F.lit(0)), ["_o"])
    sp = view(spark, sf, "v_spans")
    table.merge_ignore(sp.select(F.col("word").alias("term"),
                                 F.concat("word", F.lit(" @"), F.col("doc_id").cast("string")).alias("explanation"),
                                 "doc_id", "span_start"), ["doc_id", "span_start"])
    return table.read()


@query("s08_triples_sink", with_views("WITH" + q_triples._T01_CTES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY source_concept, relation_type, target_concept
                                   ORDER BY batch_id, line_no, line_idx, weight) AS rn FROM t)
SELECT source_concept, relation_type, target_concept, weight FROM r WHERE rn = 1
""", "v_triple_lines"))
def s08(spark, sf):
    path = scratch_dir(spark, "triples")
    t = q_triples.parsed(spark, sf)
    IO.append_triples(spark, t.where(F.col("batch_id") < 25), path, q_triples.ORDER, n_buckets=8)
    IO.append_triples(spark, t.where(F.col("batch_id") >= 25), path, q_triples.ORDER, n_buckets=8)
    return IO.read_triples(spark, path)


@query("s09_concept_graph", q_graph.J05_ORACLE)
def s09(spark, sf):
    root = scratch_dir(spark, "graph")
    q_graph.labels(spark, sf).write.parquet(f"{root}/labels")
    q_graph.edges(spark, sf).write.parquet(f"{root}/edges")
    lab, edges = IO.read_concept_graph(spark, f"{root}/labels", f"{root}/edges")
    return G.concept_neighbours(lab.select("text", "lang"), lab, edges)


@query("s10_entity_source", with_views("WITH" + q_kb._RANK_CTES + "," + q_kb._PL + f"""
SELECT qid, label, description, p31s, p279s, p527s, p361s FROM ({q_kb._lists('k')}) z
""", "v_terms", "v_entities", "v_entity_props"))
def s10(spark, sf):
    path = scratch_dir(spark, "bindings")
    IO.write_entity_bindings(q_kb._cands(spark, sf), path)
    return IO.read_entity_bindings(spark, path)


@query("s11_results_sink", with_views("""
WITH c AS (SELECT sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp,
                  sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn,
                  sum(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS correct, count(*) AS n FROM v_pred),
m AS (SELECT coalesce(correct::DOUBLE / nullif(n, 0), 0) AS accuracy,
       coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT metric, round(value, 6) AS value FROM m UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))
""", "v_pred"))
def s11(spark, sf):
    m = IO.read_metrics(spark, _written_results(spark, sf))
    return m.select("metric", F.round("value", 6).alias("value"))


def _written_results(spark, sf) -> str:
    out = scratch_dir(spark, "results")
    pred = view(spark, sf, "v_pred")
    IO.write_results(pred.select("doc_id", F.col("y").alias("true_label"), F.col("yhat").alias("predicted_label"),
                                 F.col("p").alias("sarcasm_prob")),
                     M.metrics_long(M.binary_prf(pred)), out)
    return out


@query("s11_predictions", with_views("""
SELECT doc_id, y AS true_label, yhat AS predicted_label, p AS sarcasm_prob FROM v_pred
""", "v_pred"))
def s11_predictions(spark, sf):
    return IO.read_predictions(spark, _written_results(spark, sf),
                               "doc_id BIGINT, true_label INT, predicted_label INT, sarcasm_prob DOUBLE")
