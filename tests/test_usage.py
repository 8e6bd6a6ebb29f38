"""The README usage example, run end to end on the smallest tables."""

from pyspark.sql import functions as F

from textlens.operators import knowledge as K
from textlens.operators import metrics as M
from textlens.operators import models as MD
from textlens.operators import prep as P
from textlens.session import scratch_dir
from textlens.sources import io as IO


def test_usage_example(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    path = scratch_dir(spark, "usage")
    IO.write_labeled_csv(docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")), path)

    # --- README example starts here
    corpus = IO.read_labeled_csv(spark, path).withColumn("doc_id", F.xxhash64("text"))
    corpus = P.clean_texts(corpus)                                   # mentions, urls, symbols, spaces
    lexicon = spark.createDataFrame([("the", 0.1, 0.0)], "word string, positive double, negative double")
    feats = K.knowledge_features(corpus, lexicon, K.default_slang(spark), K.default_emoji(spark))
    data = corpus.join(feats, "doc_id")
    split = P.exact_split(data, "doc_id", fraction=0.2, seed=42)     # exact 80/20 of the ids, deterministic
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model = MD.train_classifier(train, extra_cols=["positive", "negative", "n_slang", "n_emoji"],
                                num_features=1 << 10)
    pred = MD.predict(model, test, keep=["doc_id", "label"]).select(
        "doc_id", F.col("label").alias("y"), F.col("p_positive").alias("p"), F.col("prediction").alias("yhat"))
    report = M.binary_prf(pred)                                      # accuracy, precision, recall, f1
    auc = M.roc_auc(pred)                                            # trapezoidal AUC, ties grouped
    # --- README example ends here

    r = report.first()
    assert 0.0 <= r.accuracy <= 1.0 and 0.0 <= r.f1 <= 1.0
    a = auc.first().auc
    assert a is None or 0.0 <= a <= 1.0
    ids = data.select("doc_id").distinct().count()
    assert test.select("doc_id").distinct().count() == -(-ids * 2 // 10)
    assert data.count() == corpus.count()


def test_copies_under_one_id_are_counted_once(spark):
    corpus = spark.createDataFrame([("good day",), ("good day",), ("day",)], "text string").withColumn(
        "doc_id", F.xxhash64("text"))
    lexicon = spark.createDataFrame([("good", 0.5, 0.125)], "word string, positive double, negative double")
    feats = K.knowledge_features(corpus, lexicon, dict(K.SLANG), dict(K.EMOJI))
    rows = corpus.join(feats, "doc_id").select("text", "positive", "negative", "n_slang").collect()
    assert sorted(map(tuple, rows)) == [("day", 0.0, 0.0, 0), ("good day", 0.5, 0.125, 0), ("good day", 0.5, 0.125, 0)]
    split = P.exact_split(corpus, "doc_id", 0.5, 1).collect()
    assert len(split) == 3 and len({(r.text, r.split) for r in split}) == 2  # copies fall on one side
