"""Queries for the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import metrics as M
from textlens.plans.fixtures import table, view, with_views
from textlens.plans.registry import query


def _r(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


_COUNTS = """
sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp,
sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp,
sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn,
sum(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS correct, count(*) AS n"""


@query("a01_accuracy_f1", with_views(f"""
WITH c AS (SELECT {_COUNTS} FROM v_pred)
SELECT n, round(coalesce(correct::DOUBLE / nullif(n, 0), 0), 6) AS accuracy,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c
""", "v_pred"))
def a01(spark, sf):
    return _r(M.accuracy_f1(view(spark, sf, "v_pred")), "accuracy", "f1")


@query("a02_confusion_matrix", with_views("""
WITH g AS (SELECT a.c AS true_label, b.c AS predicted_label FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c))
SELECT g.true_label, g.predicted_label, count(p.doc_id) AS n
FROM g LEFT JOIN v_pred p ON p.y = g.true_label AND p.yhat = g.predicted_label
GROUP BY g.true_label, g.predicted_label
""", "v_pred"))
def a02(spark, sf):
    return M.confusion_matrix(view(spark, sf, "v_pred"))


@query("a03_binary_prf", with_views(f"""
WITH c AS (SELECT {_COUNTS} FROM v_pred)
SELECT round(coalesce(correct::DOUBLE / nullif(n, 0), 0), 6) AS accuracy,
       round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c
""", "v_pred"))
def a03(spark, sf):
    return _r(M.binary_prf(view(spark, sf, "v_pred")), "accuracy", "precision", "recall", "f1")


@query("a03_metrics_long", with_views(f"""
WITH c AS (SELECT {_COUNTS} FROM v_pred),
m AS (SELECT coalesce(correct::DOUBLE / nullif(n, 0), 0) AS accuracy,
       coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT metric, round(value, 6) AS value FROM m
UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))
""", "v_pred"))
def a03_long(spark, sf):
    return _r(M.metrics_long(M.binary_prf(view(spark, sf, "v_pred"))), "value")


_A04 = with_views("""
WITH cls AS (SELECT * FROM (VALUES (0), (1)) t(c)),
per AS (
  SELECT p.task, cls.c,
         sum(CASE WHEN p.y = cls.c AND p.yhat = cls.c THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p.y = cls.c THEN 1 ELSE 0 END) AS support,
         sum(CASE WHEN p.yhat = cls.c THEN 1 ELSE 0 END) AS pred
  FROM v_pred_long p, cls GROUP BY p.task, cls.c),
m AS (SELECT task, CAST(c AS VARCHAR) AS row, tp, support,
             coalesce(tp::DOUBLE / nullif(pred, 0), 0) AS precision,
             coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
             coalesce(2.0 * tp / nullif(pred + support, 0), 0) AS f1 FROM per),
t AS (SELECT task, sum(support) AS n, sum(tp) AS tp,
             avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
             sum(f1 * support) / sum(support) AS wf FROM m GROUP BY task)
SELECT task, row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM m
UNION ALL SELECT task, 'accuracy', round(tp::DOUBLE / n, 6), round(tp::DOUBLE / n, 6), round(tp::DOUBLE / n, 6), n FROM t
UNION ALL SELECT task, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM t
UNION ALL SELECT task, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM t
""", "v_pred_long")


@query("a04_classification_report", _A04)
def a04(spark, sf):
    return _r(M.classification_report(view(spark, sf, "v_pred_long")), "precision", "recall", "f1")


_ROC_BASE = """
WITH g AS (SELECT task, p AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS fp FROM v_pred_long GROUP BY task, p),
c AS (SELECT *, sum(tp) OVER (PARTITION BY task ORDER BY threshold DESC) AS cum_tp,
                sum(fp) OVER (PARTITION BY task ORDER BY threshold DESC) AS cum_fp,
                sum(tp) OVER (PARTITION BY task) AS P, sum(fp) OVER (PARTITION BY task) AS N FROM g)
"""


@query("a05_roc_curve", with_views(_ROC_BASE + """
SELECT task, threshold, round(cum_fp::DOUBLE / nullif(N, 0), 6) AS fpr,
       round(cum_tp::DOUBLE / nullif(P, 0), 6) AS tpr FROM c
""", "v_pred_long"))
def a05_curve(spark, sf):
    return _r(M.roc_curve(view(spark, sf, "v_pred_long"), by=["task"]), "fpr", "tpr")


@query("a05_roc_curve_corners", with_views(_ROC_BASE + """,
d AS (SELECT *, lag(cum_fp) OVER w AS pfp, lead(cum_fp) OVER w AS nfp, lag(cum_tp) OVER w AS ptp,
             lead(cum_tp) OVER w AS ntp FROM c WINDOW w AS (PARTITION BY task ORDER BY threshold DESC))
SELECT task, threshold, round(cum_fp::DOUBLE / nullif(N, 0), 6) AS fpr, round(cum_tp::DOUBLE / nullif(P, 0), 6) AS tpr
FROM d WHERE pfp IS NULL OR nfp IS NULL OR nfp - 2 * cum_fp + pfp <> 0 OR ntp - 2 * cum_tp + ptp <> 0
UNION ALL SELECT DISTINCT task, CAST('Infinity' AS DOUBLE), CASE WHEN N > 0 THEN 0.0 END, CASE WHEN P > 0 THEN 0.0 END FROM c
""", "v_pred_long"))
def a05_corners(spark, sf):
    out = M.roc_curve(view(spark, sf, "v_pred_long"), by=["task"], drop_intermediate=True, include_origin=True)
    return _r(out, "fpr", "tpr")


@query("a05_roc_auc", with_views(_ROC_BASE + """
SELECT task, round(sum(fp * (2 * cum_tp - tp))::DOUBLE / nullif(2.0 * max(P) * max(N), 0), 6) AS auc
FROM c GROUP BY task
""", "v_pred_long"))
def a05_auc(spark, sf):
    return _r(M.roc_auc(view(spark, sf, "v_pred_long"), by=["task"]), "auc")


@query("a06_class_balance", with_views("""
SELECT task, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n_class0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n_class1,
       round(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS ratio_class1,
       count(DISTINCT yhat) = 1 AS single_class_pred
FROM v_pred_long GROUP BY task
""", "v_pred_long"))
def a06(spark, sf):
    return _r(M.class_balance(view(spark, sf, "v_pred_long")), "ratio_class1")


A11_ORACLE = with_views("""
SELECT worker_id, count(*) AS total_requests, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS failed_requests,
       ((sum(CAST(round(seconds * 10000) AS BIGINT)) + 50 * count(*)) // (100 * count(*))) / 100.0
         AS avg_response_sec,
       round(1 - sum(CASE WHEN ok THEN 0 ELSE 1 END)::DOUBLE / count(*), 6) AS success_rate
FROM v_attempts GROUP BY worker_id
""", "v_attempts")


@query("a11_request_stats", A11_ORACLE)
def a11(spark, sf):
    return _r(M.request_stats(view(spark, sf, "v_attempts")), "avg_response_sec", "success_rate")


@query("a11_cache_size", """
WITH r AS (SELECT conv_id % 5 AS worker_id, turn % 3 <> 2 AS ok, substr(text, 1, 150) || '|' || role AS key
           FROM conversations)
SELECT worker_id, count(*) AS total_requests, count(*) FILTER (WHERE NOT ok) AS failed_requests,
       count(DISTINCT CASE WHEN ok THEN key END) AS cache_size FROM r GROUP BY worker_id
""")
def a11_cache(spark, sf):
    r = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 5).alias("worker_id"), (F.col("turn") % 3 != 2).alias("ok"), F.col("turn").alias("seconds"),
        M.cache_key(F.col("text"), F.col("role")).alias("key"))
    return M.request_stats(r, key_col="key").select("worker_id", "total_requests", "failed_requests", "cache_size")


@query("a12_multitask_loss", with_views("""
WITH l AS (
  SELECT task, -avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15))
                         ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS loss,
         CAST(CASE task WHEN 'sarcasm' THEN 2.0 ELSE 0.3 END AS DOUBLE) AS weight
  FROM v_pred_long GROUP BY task)
SELECT task, round(loss, 6) AS loss, weight FROM l
UNION ALL SELECT 'total', round(sum(loss * weight), 6), CAST(NULL AS DOUBLE) FROM l
""", "v_pred_long"))
def a12(spark, sf):
    return _r(M.multitask_loss(view(spark, sf, "v_pred_long")), "loss")


@query("a14_vector_profile", """
SELECT vec_id, len(embedding) AS dim, round(list_min(embedding)::DOUBLE, 6) + 0.0 AS vmin,
       round(list_max(embedding)::DOUBLE, 6) + 0.0 AS vmax,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
FROM embeddings
""")
def a14(spark, sf):
    return _r(M.vector_profile(table(spark, sf, "embeddings")), "vmin", "vmax", "norm")


@query("m06_select_checkpoint", """
SELECT user_id AS run_id, event_id AS step, value AS eval_loss, rank FROM (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY value ASC, event_id ASC) AS rank FROM events) t
WHERE rank <= 2
""")
def m06(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                                             F.col("value").alias("eval_loss"))
    return M.select_checkpoint(runs)
