"""Row-level text expressions against plain-Python statements of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from textlens.functions.text import clean_text, py_strip, ws_tokens
from textlens.operators import prep as P

CASES = [
    "@user1 #tag Hello   world! http://x.y/z?q=1 ok",
    "  ça   va?  très-bien... 'quoted' ",
    "tabs\tand\nnewlines nbsp em",
    "emoji 😂 and symbols $5 %, & done",
    "",
    "@only #tags",
    "mixed_under_score 123 ٣٤ digits",
    "http://start and mid http://a end",
]


def py_clean(t: str) -> str:
    t = re.sub(r"@\w+|#\w+", "", t)
    t = re.sub(r"http\S+", "", t)
    t = re.sub(r"[^\w\s\-'?.!]", "", t)
    t = re.sub(r"\s+", " ", t)
    return t.strip()


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", clean_text("text").alias("c")).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == py_clean(t), t


def test_strip_and_tokens(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    rows = df.select("text", py_strip("text").alias("s"), ws_tokens("text").alias("k")).collect()
    for r in rows:
        assert r.s == r.text.strip()
        assert list(r.k) == r.text.split()


def test_dialogue_text_keeps_leading_space(spark):
    df = spark.createDataFrame([([], "resp", "SARCASM"), (["a", "b"], "c", "no"), (None, "x", None)],
                               "context array<string>, response string, label string")
    rows = df.select(P.dialogue_text(F.coalesce("context", F.array().cast("array<string>")), F.col("response"))
                     .alias("t"), P.binarize_label("label").alias("y")).collect()
    assert [(r.t, r.y) for r in rows] == [(" resp", 1), ("a b c", 0), (" x", 0)]


@pytest.mark.parametrize("raw,value,valid", [(" 1 ", 1, True), ("0", 0, True), ("yes", 0, False),
                                              (None, 0, False), ("1\n", 1, True), ("10", 0, False)])
def test_parse_binary_answer(spark, raw, value, valid):
    r = spark.createDataFrame([(raw,)], "a string").select(P.parse_binary_answer("a").alias("x")).first().x
    assert (r.value, r.valid) == (value, valid)


def test_validate_explanation(spark):
    text = "  Literal meaning\n\n  Context: x \nCultural note\nSentiment: neg  "
    r = spark.createDataFrame([(text,), ("literal only",)], "t string").select(
        P.validate_explanation("t").alias("e")).collect()
    assert r[0].e == "\n".join(line.strip() for line in text.split("\n") if line.strip())
    assert r[1].e is None


def test_token_window_longest(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "id int, text string")
    rows = {r.id: r for r in P.token_window(df, "text", max_length=2, pad="longest").collect()}
    assert list(rows[1].tokens) == ["a", "b"] and list(rows[1].attention_mask) == [1, 1]
    assert list(rows[2].tokens) == ["d", "[PAD]"] and list(rows[2].attention_mask) == [1, 0]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x1"), (3, None), (4, " 7 "), (5, "1.5d")], "id int, k string")
    good, bad = P.quarantine_rows(df, {"k": "int"})
    assert sorted((r.id, r.k) for r in good.collect()) == [(1, 12), (3, None), (4, 7)]
    assert sorted(r.id for r in bad.collect()) == [2, 5]
    good2, bad2 = P.quarantine_rows(df, {"k": "int"}, default={"k": -1})
    # with a default, failed and missing values are both replaced
    assert bad2.count() == 0 and sorted(r.k for r in good2.collect()) == [-1, -1, -1, 7, 12]
