"""Source/sink round trips with awkward literals."""

import json

import pytest

from pyspark.sql import functions as F

from textlens.session import scratch_dir
from textlens.sources import io as IO

TEXTS = ['plain', 'with "quotes" and, commas', 'multi\nline\r\ntext', 'back\\slash', '', '  spaced  ', 'ünï 😂']


def test_labeled_csv_round_trip(spark):
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(TEXTS)], "text string, label int")
    path = scratch_dir(spark, "t-csv")
    IO.write_labeled_csv(df, path)
    got = sorted((r.text if r.text is not None else "<null>", r.label) for r in IO.read_labeled_csv(spark, path).collect())
    # an empty text reads back as NULL (pandas semantics); everything else is exact
    want = sorted((t if t != "" else "<null>", i % 2) for i, t in enumerate(TEXTS))
    assert got == want


def test_text_column_na_tokens(spark):
    vals = ["keep me", "NA", "null", "None", "", "n/a", "#N/A", "nan", "NaN", "ok NA"]
    df = spark.createDataFrame([(v, 1) for v in vals], "text string, label int")
    path = scratch_dir(spark, "t-na")
    IO.write_labeled_csv(df, path)
    assert sorted(r.text for r in IO.read_text_column(spark, path).collect()) == ["keep me", "ok NA"]


def test_term_array_file(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("ç",)], "term string")
    path = scratch_dir(spark, "t-arr")
    IO.write_terms_array(df, path)
    raw = spark.read.text(path).first().value
    assert json.loads(raw) == ["a", "b", "ç"]
    assert sorted(r.term for r in IO.read_terms(spark, path, array_file=True).collect()) == ["a", "b", "ç"]


def test_term_array_in_many_parts(spark, tmp_path):
    terms = [f"t {i}" for i in range(2000)] + ['"', "]", "[", ",", ",]", "a\nb", "\\", "", " ", "é😂"]
    df = spark.createDataFrame([(t,) for t in [*terms, *terms, None]], "term string")
    path = str(tmp_path / "arr")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        IO.write_terms_array(df, path)
    finally:
        spark.conf.set(merge, before)
    parts = sorted((tmp_path / "arr").glob("part-*"))
    assert len(parts) > 1
    assert json.loads("".join(p.read_text() for p in parts)) == sorted(terms)
    assert sorted(r.term for r in IO.read_terms(spark, path, array_file=True).collect()) == sorted(terms)
    IO.write_terms_array(df.limit(0), path)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "arr").glob("part-*")))) == []
    assert IO.read_terms(spark, path, array_file=True).collect() == []


def test_dialogues_with_corrupt_line(spark):
    path = scratch_dir(spark, "t-dlg")
    lines = ['{"context": ["a", "b"], "response": "c", "label": "SARCASM"}',
             '{"context": [], "response": "r", "label": "NOT"}',
             '{not json', '{"context": ["a"], "label": "SARCASM"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good = IO.read_dialogues(spark, path, skip_bad=True)
    assert sorted(map(tuple, good.collect())) == [(" r", 0), ("a b c", 1)]
    assert sorted(r.problem for r in IO.bad_dialogue_lines(spark, path).collect()) == ["malformed line", "missing response"]
    with pytest.raises(Exception, match="malformed line|missing response"):
        IO.read_dialogues(spark, path).collect()


def test_entity_bindings_multiline(spark):
    doc = {"head": {"vars": ["entity"]}, "results": {"bindings": [
        {"entity": {"type": "uri", "value": "http://www.wikidata.org/entity/Q42"},
         "entityLabel": {"type": "literal", "value": "Douglas"},
         "p31s": {"type": "literal", "value": "human | writer"}},
        {"entity": {"type": "uri", "value": "http://www.wikidata.org/entity/Q1"},
         "entityLabel": {"type": "literal", "value": "Universe"},
         "description": {"type": "literal", "value": "all of space"}}]}}
    path = scratch_dir(spark, "t-sparql")
    spark.createDataFrame([(json.dumps(doc, indent=2),)], "value string").coalesce(1).write.text(path)
    rows = {r.qid: r for r in IO.read_entity_bindings(spark, path, multiline=True).collect()}
    assert rows["Q42"].description == "" and rows["Q42"].p31s == "human | writer" and rows["Q42"].p279s == ""
    assert rows["Q1"].label == "Universe" and rows["Q1"].description == "all of space"


def test_term_table_insert_ignore(spark):
    t = IO.TermTable(spark, scratch_dir(spark, "t-tt")).create_if_missing()
    a = spark.createDataFrame([("x", "first", 1), ("x", "second", 2), ("y", "why", 1)], "term string, explanation string, o int")
    t.merge_ignore(a, ["o"])
    t.merge_ignore(a.withColumn("explanation", F.lit("late")), ["o"])
    assert sorted(map(tuple, t.read().collect())) == [("x", "first"), ("y", "why")]


def test_concept_graph_round_trip(spark):
    from textlens.operators import graph as G

    root = scratch_dir(spark, "t-graph")
    labels = spark.createDataFrame([("apple", "en", "c1"), ("apple", "en", "c2"), ("pie", "en", "c3")],
                                   IO.LABEL_SCHEMA)
    edges = G.edges_from(spark.createDataFrame([("c2", "related_to", "c3"), ("c2", "is_a", "c1"),
                                                ("c1", "smells", "c3")], "src string, rel string, dst string"))
    labels.write.parquet(f"{root}/labels")
    edges.write.parquet(f"{root}/edges")
    lab, edg = IO.read_concept_graph(spark, f"{root}/labels", f"{root}/edges")
    out = G.concept_neighbours(lab.where("text = 'apple'"), lab, edg).orderBy("idx").collect()
    # c2 has two outgoing edges, c1 one, so c2 is the busiest concept of "apple"; edges ordered by uri
    assert [(r.start, r.relation, r.end_label) for r in out] == [("c2", "is_a", "apple"), ("c2", "related_to", "pie")]
