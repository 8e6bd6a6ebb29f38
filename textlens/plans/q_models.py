"""Queries for model training and prediction (M04, M05): which rows are held
out, their labels, and whether the fitted model does at least as well on them
as always answering the commoner class."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import knowledge as K
from textlens.operators import models as MD
from textlens.operators import metrics as M
from textlens.operators import prep as P
from textlens.operators import training as TR
from textlens.plans.fixtures import view
from textlens.plans.registry import query
from textlens.session import materialize, scratch_dir

N_FEATURES = 1 << 12
KNOWLEDGE = ["positive", "negative", "n_slang", "n_emoji"]


LANGUAGES = ("en", "fr", "de", "es")


def _labelled(spark, sf):
    """All documents with a 0/1 label per language (what their words decide),
    the knowledge features and the split."""
    v = view(spark, sf, "v_corpus").select(
        "doc_id", "text", *[F.coalesce(F.col("lang") == x, F.lit(False)).cast("int").alias(f"is_{x}") for x in LANGUAGES])
    split = P.exact_split(v.select("doc_id"), "doc_id", 0.2, 42)
    kf = K.knowledge_features(v, view(spark, sf, "v_lexicon"), dict(K.SLANG), dict(K.EMOJI)).select(
        "doc_id", *[F.col(c).cast("double").alias(c) for c in KNOWLEDGE])
    path = scratch_dir(spark, "labelled")  # written once: fitting, features and prediction each read it
    v.join(kf, "doc_id").join(split, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def _accurate(pred, y: str, yhat: str, by=()):
    """``pred`` with, per group, whether at least nine in ten labels are met
    and more of them than the commoner class would meet."""
    g = pred.groupBy(*by).agg(F.avg((F.col(y) == F.col(yhat)).cast("int")).alias("_a"), F.avg(F.col(y)).alias("_m"))
    ok = (F.col("_a") >= 0.9) & (F.col("_a") > F.greatest(F.col("_m"), 1 - F.col("_m")))
    ok = g.select(*by, ok.alias("accurate"))
    return pred.join(F.broadcast(ok), list(by)) if by else pred.withColumn("accurate", F.lit(ok.first()["accurate"]))


_HELD_OUT = """
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk,
             count(*) OVER () AS n FROM documents),
t AS (SELECT doc_id, coalesce(lang, '') AS lang FROM r WHERE rk <= ceil(n * 2 / 10))"""


@query("m04_train_classifier", f"""
WITH {_HELD_OUT}
SELECT doc_id, CAST(lang = 'en' AS INT) AS label, true AS accurate FROM t
""")
def m04(spark, sf):
    data = _labelled(spark, sf).withColumnRenamed("is_en", "label")
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    model = MD.train_classifier(train, extra_cols=KNOWLEDGE, num_features=N_FEATURES)
    path = scratch_dir(spark, "classifier")
    MD.save_model(model, path)
    pred = materialize(MD.predict(MD.load_model(path), test, keep=["doc_id", "label"]))
    return _accurate(pred, "label", "prediction").select("doc_id", "label", "accurate")


@query("m05_train_multitask", f"""
WITH {_HELD_OUT}
""" + "UNION ALL ".join(f"SELECT doc_id, '{x}' AS task, CAST(lang = '{x}' AS INT) AS y, true AS accurate FROM t\n"
                        for x in LANGUAGES))
def m05(spark, sf):
    data = _labelled(spark, sf)
    labels = {x: f"is_{x}" for x in LANGUAGES}
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    feats, heads = MD.train_multitask(train, labels, extra_cols=KNOWLEDGE, num_features=N_FEATURES)
    pred = materialize(MD.predict_multitask(feats, heads, test, labels, "doc_id"))
    return _accurate(pred, "y", "yhat", ["task"]).select("doc_id", "task", "y", "accurate")


#: The combined loss weighs the first task 2.0 and the others 0.3 each.
JOINT_WEIGHTS = dict(zip(LANGUAGES, M.TASK_WEIGHTS.values()))


def _joint_run(spark, train, test, folder, steps=20):
    return TR.train_joint(train, test, {x: f"is_{x}" for x in LANGUAGES}, folder, weights=JOINT_WEIGHTS,
                          extra_cols=KNOWLEDGE, n_words=N_FEATURES, steps=steps, eval_every=5)


@query("m05_joint_multitask", f"""
WITH {_HELD_OUT}
""" + "UNION ALL ".join(f"SELECT doc_id, '{x}' AS task, CAST(lang = '{x}' AS INT) AS y, true AS accurate, true AS no_worse FROM t\n"
                        for x in LANGUAGES))
def m05_joint(spark, sf):
    """Heads on one projection, fitted under the combined loss: held-out labels,
    whether they are met, and whether the combined loss (A12) is at or below
    that of separate heads."""
    data = _labelled(spark, sf)
    labels = {x: f"is_{x}" for x in LANGUAGES}
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    net = _joint_run(spark, train, test, scratch_dir(spark, "joint")).best()
    pred = materialize(net.predict(test, "doc_id", label_cols=labels))
    feats, heads = MD.train_multitask(train, labels, extra_cols=KNOWLEDGE, num_features=N_FEATURES)
    apart = MD.predict_multitask(feats, heads, test, labels, "doc_id")
    total = [M.multitask_loss(x, JOINT_WEIGHTS).where(F.col("task") == "total").first()["loss"] for x in (pred, apart)]
    return _accurate(pred, "y", "yhat", ["task"]).select("doc_id", "task", "y", "accurate", F.lit(total[0] <= total[1]).alias("no_worse"))


class _Lost(Exception):
    """Stands for a run that ends without warning."""


@query("m06_checkpointed_training", f"""
WITH {_HELD_OUT}
""" + "UNION ALL ".join(f"SELECT doc_id, '{x}' AS task, true AS same FROM t\n" for x in LANGUAGES))
def m06_training(spark, sf):
    """A run that is lost behind its second checkpoint and goes on from there
    predicts, reloaded, what a run that was never stopped predicts."""
    data = _labelled(spark, sf)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    whole = _joint_run(spark, train, test, scratch_dir(spark, "whole"), 15).best()
    folder = scratch_dir(spark, "resumed")

    def lost(step: int) -> None:
        if step == 10:
            raise _Lost

    try:
        TR.train_joint(train, test, {x: f"is_{x}" for x in LANGUAGES}, folder, weights=JOINT_WEIGHTS, extra_cols=KNOWLEDGE,
                       n_words=N_FEATURES, steps=15, eval_every=5, after_checkpoint=lost)
    except _Lost:
        pass
    resumed = _joint_run(spark, train, test, folder, 15).best()
    a, b = (net.predict(test, "doc_id").select("doc_id", "task", F.col("p").alias(n)) for net, n in ((whole, "p"), (resumed, "q")))
    return a.join(b, ["doc_id", "task"]).select("doc_id", "task", (F.col("p") == F.col("q")).alias("same"))
