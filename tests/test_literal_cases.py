"""Hand-written literal cases: sample sentences with a target phrase, the
empty string and a 1000-word text as boundary cases, single-term lookups."""

from pyspark.sql import functions as F

from textlens.functions.text import clean_text
from textlens.operators import kb as KB
from textlens.operators import metrics as M
from textlens.operators import prep as P
from textlens.operators import scoring as S

SENTENCES = [
    ("This 'state-of-the-art' system crashed again", "state-of-the-art"),
    ("Great job missing all the deadlines!", "Great job"),
    ("Another 'urgent' email that could've been a text", "urgent"),
    ("This is absolutely fantastic!", None),
    ("Oh great, another system crash.", None),
    ("The performance is lightning fast", None),
    ("", None),
    (" ".join(["test"] * 1000), None),
]


def _df(spark):
    return spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(SENTENCES)],
                                 "id int, text string, entity string")


def test_prompts_cleaning_and_windows(spark):
    df = _df(spark)
    out = {r.id: r for r in df.select(
        "id", clean_text("text").alias("c"),
        P.render_prompt("Text: {text}\nTarget: {entity}", text=F.col("text"),
                        entity=F.coalesce("entity", F.lit(""))).alias("prompt")).collect()}
    assert out[0].c == "This 'state-of-the-art' system crashed again"
    assert out[2].c == "Another 'urgent' email that could've been a text"
    assert out[6].c == "" and out[0].prompt.endswith("Target: state-of-the-art")
    w = {r.id: r for r in P.token_window(df, "text", 128).collect()}
    assert sum(w[7].attention_mask) == 128 and len(w[7].tokens) == 128   # the 1000-word text is cut
    assert sum(w[6].attention_mask) == 0 and w[6].tokens == ["[PAD]"] * 128


def test_scoring_boundary_texts(spark):
    s = {r.id: r for r in S.score_texts(_df(spark), S.vowel_length_predictor, keep=["id"]).collect()}
    assert s[6].error is None and s[6].prediction == 0 and abs(s[6].p_positive - 0.5) < 1e-12
    assert s[7].error is None and 0.0 <= s[7].p_positive <= 1.0
    prof = M.vector_profile(spark.createDataFrame([(1, [0.0] * 3072)], "vec_id int, embedding array<float>")).first()
    assert (prof.dim, prof.norm) == (3072, 0.0)


def test_single_term_lookups(spark):
    ents = spark.createDataFrame([("Q1", "Bitcoin BTC", "cryptocurrency"), ("Q2", "BTC", "ticker symbol"),
                                  ("Q3", "Apple Inc.", "technology company"), ("Q4", "apple", "fruit"),
                                  ("Q5", "Pineapple", "plant")], "qid string, label string, description string")
    props = spark.createDataFrame([("Q4", "P31", "fruit"), ("Q4", "P279", "pome")], "qid string, prop string, value string")
    terms = spark.createDataFrame([("BTC",), ("apple",)], "term string")
    c = KB.entity_candidates(terms, ents, props).orderBy("term", "rank").collect()
    assert [(r.term, r.qid) for r in c if r.term == "BTC"] == [("BTC", "Q2"), ("BTC", "Q1")]
    assert [r.qid for r in c if r.term == "apple"] == ["Q4", "Q3", "Q5"]
    assert [r.p31s for r in c if r.qid == "Q4"] == ["fruit"]
    text = {r.term: r.explanation for r in KB.explanation_text(
        KB.rank_candidates(KB.candidate_matches(terms, ents.select("qid", F.col("label").alias("name"))), ents)).collect()}
    assert text["BTC"] == "BTC, ticker symbol\nBTC, cryptocurrency"


def test_candidates_through_aliases(spark):
    ents = spark.createDataFrame([("Q1", "Bitcoin", "cryptocurrency"), ("Q2", "Litecoin", "coin")],
                                 "qid string, label string, description string")
    aliases = spark.createDataFrame([("Q1", "BTC"), ("Q1", "XBT")], "qid string, alias string")
    props = spark.createDataFrame([], "qid string, prop string, value string")
    terms = spark.createDataFrame([("btc",), ("coin",)], "term string")
    c = KB.entity_candidates(terms, ents, props, aliases=aliases).collect()
    assert {(r.term, r.qid) for r in c} == {("btc", "Q1"), ("coin", "Q1"), ("coin", "Q2")}
