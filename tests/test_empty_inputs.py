"""Operators accept empty inputs and return empty (or zero) results."""

from textlens.operators import entities as E
from textlens.operators import graph as G
from textlens.operators import kb as KB
from textlens.operators import knowledge as K
from textlens.operators import metrics as M
from textlens.operators import prep as P
from textlens.operators import scoring as S
from textlens.operators import triples as T


def test_empty_inputs(spark):
    texts = spark.createDataFrame([], "doc_id long, text string")
    lex = spark.createDataFrame([], "word string, positive double, negative double")
    assert K.knowledge_features(texts, lex, K.default_slang(spark), K.default_emoji(spark)).count() == 0
    assert T.parse_triples(texts, "text").count() == 0
    spans = spark.createDataFrame([], "doc_id long, span_start int, span_end int, word string, score double")
    assert E.merge_spans(spans).count() == 0
    preds = spark.createDataFrame([], "y int, p double, yhat int, task string")
    # an ungrouped metric over no rows is one NULL row, like a SQL aggregate
    assert [r.auc for r in M.roc_auc(preds).collect()] == [None]
    assert M.roc_auc(preds, by=["task"]).count() == 0 and M.roc_curve(preds, by=["task"]).count() == 0
    assert M.classification_report(preds).count() == 0
    assert P.exact_split(texts, "doc_id").count() == 0
    ents = spark.createDataFrame([], "qid string, label string, description string")
    props = spark.createDataFrame([], "qid string, prop string, value string")
    assert KB.entity_candidates(texts.selectExpr("text AS term"), ents, props).count() == 0
    labels = spark.createDataFrame([], "text string, lang string, concept string")
    edges = spark.createDataFrame([], "start string, relation string, end string, uri string")
    assert G.concept_neighbours(labels, labels, edges).count() == 0
    assert G.two_hop_classes(spark.createDataFrame([], "seed string"), edges).count() == 0
    assert S.score_texts(texts, S.vowel_length_predictor, keep=["doc_id"]).count() == 0
    assert S.loo_attribution(texts, S.vowel_length_predictor, ["doc_id"]).count() == 0
