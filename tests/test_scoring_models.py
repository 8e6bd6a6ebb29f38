"""Scoring failure isolation, softmax/argmax, attribution shapes, knowledge vector, model fit."""

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textlens.operators import knowledge as K
from textlens.operators import models as MD
from textlens.operators import scoring as S


def test_score_texts_isolates_failures(spark):
    # Defined inside the test so the closure is shipped by value to the workers.
    def make_boom():
        def boom(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("bad input")
            return np.array([[0.0, 1.0] if len(t) % 2 else [1.0, 1.0] for t in texts])
        return boom

    df = spark.createDataFrame([(1, "ab"), (2, "boom!"), (3, "abc"), (4, None)], "id int, text string")
    rows = {r.id: r for r in S.score_texts(df, make_boom, keep=["id"], batch_size=4).collect()}
    assert rows[2].logits is None and "bad input" in rows[2].error
    assert rows[4].logits is None and rows[4].error == "missing text"
    assert rows[1].prediction == 0 and abs(rows[1].p_positive - 0.5) < 1e-12  # tie -> lowest class
    assert rows[3].prediction == 1 and abs(rows[3].p_positive - 1 / (1 + math.exp(-1))) < 1e-12


def test_dedupe_scores_each_text_once(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(20)] + [(99, "other")], "id int, text string")
    out = S.score_texts(df, S.vowel_length_predictor, keep=["id"], dedupe=True)
    assert out.count() == 21 and out.select("p_positive").distinct().count() == 2


def test_attribution_shapes(spark):
    df = spark.createDataFrame([(1, "a quick brown fox jumps"), (2, "zzz")], "id int, text string")
    loo = S.loo_attribution(df, S.vowel_length_predictor, ["id"], k=3).collect()
    assert sorted(r.rank for r in loo if r.id == 1) == [1, 2, 3] and [r.token for r in loo if r.id == 2] == ["zzz"]
    samp = S.sampled_attribution(df, S.vowel_length_predictor, ["id"], n_samples=16, k=3).collect()
    assert len([r for r in samp if r.id == 1]) == 3
    assert {r.token for r in samp if r.id == 1} <= set("a quick brown fox jumps".split())


def test_knowledge_vector(spark):
    f = spark.createDataFrame([(1, 0.5, 0.25, 2, 1)], "doc_id int, positive double, negative double, n_slang int, n_emoji int")
    out = K.knowledge_vector(f)
    v = out.select(vector_to_array("knowledge").alias("a")).first().a
    assert len(v) == 192 and v[:4] == [0.5, 0.25, 2.0, 1.0] and not any(v[4:])
    from pyspark.ml.linalg import SparseVector
    assert isinstance(out.first().knowledge, SparseVector) and out.columns == f.columns + ["knowledge"]


def test_train_and_predict(spark):
    rows = [(i, ("great fun " if i % 2 else "dull boring ") * 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    model = MD.train_classifier(df, num_features=1 << 8, max_iter=20)
    pred = MD.predict(model, df, keep=["doc_id", "label"])
    acc = pred.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc == 1.0


def test_encode_texts_pads_and_masks(spark):
    def make_tok():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "abcdefgh"), (3, None)], "id int, text string")
    rows = {r.id: r for r in S.encode_texts(df, make_tok, keep=["id"], max_length=5).collect()}
    assert list(rows[1].input_ids) == [97, 98, 99, 0, 0] and list(rows[1].attention_mask) == [1, 1, 1, 0, 0]
    assert list(rows[2].input_ids) == [97, 98, 99, 100, 101] and list(rows[2].attention_mask) == [1] * 5
    assert list(rows[3].attention_mask) == [0] * 5


def test_vector_profile_scaled(spark):
    from textlens.operators import metrics as M

    df = spark.createDataFrame([(1, [3.0, -4.0]), (2, [0.5, 0.5, 0.5, 0.5])], "vec_id int, embedding array<double>")
    r = {x.vec_id: x for x in M.vector_profile(df).collect()}
    assert (r[1].dim, r[1].vmin, r[1].vmax, r[1].norm) == (2, -4.0, 3.0, 5.0)
    assert r[2].norm == 1.0


def test_multiclass_scores(spark):
    def make():
        return lambda texts: np.array([[0.0, 2.0, 2.0] if "tie" in t else [3.0, 1.0, 0.0] for t in texts])

    df = spark.createDataFrame([(1, "tie here"), (2, "other")], "id int, text string")
    rows = {r.id: r for r in S.score_texts(df, make, keep=["id"], positive=2).collect()}
    assert rows[1].prediction == 1                      # tie between classes 1 and 2 -> lowest
    assert abs(sum(rows[1].probs) - 1.0) < 1e-12 and abs(rows[1].p_positive - rows[1].probs[2]) < 1e-15
    assert rows[2].prediction == 0 and len(rows[2].logits) == 3
