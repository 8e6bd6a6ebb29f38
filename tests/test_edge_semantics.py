"""Cases whose answer must not depend on sizes, copies or missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.operators import entities as E
from textlens.operators import graph as G
from textlens.operators import knowledge as K
from textlens.operators import metrics as M
from textlens.operators import prep as P
from textlens.operators import scoring as S
from textlens.operators import triples as T
from textlens.operators import vectors as V


def test_spans_without_offsets_and_of_no_length(spark):
    rows = [(1, 0, 0, 0, "Zero", 0.9), (2, 0, 0, 3, "New", 0.9), (2, 1, None, None, "York", 0.95),
            (2, 2, 5, 9, "City", 0.99), (3, 0, 0, 4, "Al##so", 0.9), (3, 1, 4, 4, "here", 0.9)]
    df = spark.createDataFrame(rows, "doc_id int, n int, span_start int, span_end int, word string, score double")
    got = {(r.doc_id, r.phrase) for r in E.merge_spans(df, order=["n"]).collect()}
    # a span without offsets never breaks; the next one breaks, as 5 is not the 0 that stands for the absent end
    assert got == {(1, "Zero"), (2, "New York"), (2, "City"), (3, "Also here")}
    plain = {(r.doc_id, r.phrase) for r in E.merge_spans(df.where("doc_id <> 2")).collect()}
    assert plain == {(1, "Zero"), (3, "Also here")}


def _padding(n):
    return {f"zz{i}": f"word{i}" for i in range(n)}


@pytest.mark.parametrize("extra", [0, 100])
def test_slang_of_any_size_and_form(spark, extra):
    d = {"lol": "laughing", "tbh": "to be honest", **_padding(extra)}
    df = spark.createDataFrame([(7, "lol a"), (7, "lol a"), (7, "b TBH lol"), (8, ""), (9, None), (None, "lol")],
                               "doc_id int, text string")
    table = spark.createDataFrame([*d.items(), ("lol", "zzz later in order"), (None, "x")], "slang string, expansion string")
    for form in (d, table):
        got = sorted(((r.doc_id or 0), r.expanded, r.n_slang) for r in K.slang_expand(df, form).collect() if r.text is not None)
        assert got == [(0, "laughing", 1), (7, "b to be honest laughing", 2), (7, "laughing a", 1), (7, "laughing a", 1), (8, "", 0)]


@pytest.mark.parametrize("extra", [0, 100])
def test_emoji_of_any_size(spark, extra):
    d = {"❤": "heart", "❤️": "love", "🔥": "hot 😂", "😂": "laugh", **{chr(0x1F900 + i): f"m{i}" for i in range(extra)}}
    df = spark.createDataFrame([(1, "a❤️b🔥"), (2, "❤ ❤️ 😂"), (3, None)], "doc_id int, text string")
    one = {r.doc_id: (r.expanded, r.n_emoji) for r in K.emoji_expand(df, d).collect()}
    every = {r.doc_id: r.n_emoji for r in K.emoji_expand(df, d, count="sequence").collect()}
    assert one == {1: ("a love b hot 😂 ", 1), 2: (" heart   love   laugh ", 2), 3: (None, 0)}
    assert every == {1: 2, 2: 3, 3: 0}
    table = spark.createDataFrame(list(d.items()), "emoji string, meaning string")
    assert {r.doc_id: (r.expanded, r.n_emoji) for r in K.emoji_expand(df, table).collect()} == one


def test_auc_beyond_a_long(spark, monkeypatch):
    rows = [(i / 10, 800_000_000 if i >= 5 else 0, 0 if i >= 5 else 800_000_000) for i in range(10)]
    rows = [(t, tp * 2, fp * 2) for t, tp, fp in rows]
    pts, cum = [], 0
    for t, tp, fp in sorted(rows, reverse=True):
        cum += tp
        pts.append((t, tp, fp, cum, 8_000_000_000, 8_000_000_000))
    df = spark.createDataFrame(pts, "threshold double, tp long, fp long, cum_tp long, P long, N long")
    monkeypatch.setattr(M, "_roc_points", lambda *a, **k: df)
    assert M.roc_auc(df).first().auc == pytest.approx(1.0)


def test_missing_text_keeps_its_error_with_dedupe(spark):
    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "aa")], "id int, text string")
    got = {r.id: r.error for r in S.score_texts(df, S.vowel_length_predictor, keep=["id"], dedupe=True).collect()}
    assert got == {1: None, 2: "missing text", 3: None}


def test_zero_as_text_selects(spark):
    nodes = spark.createDataFrame([("n1", "0", 5), ("n2", "", 6), ("n3", "1", 7)], "node string, grp string, x int")
    edges = spark.createDataFrame([("n1", "0", "n2"), ("n3", "1", "n3")], "start string, relation string, end string")
    by_node = {r.node: r.hidden for r in G.select_nodes_by_property(nodes, "grp", ["0", "", 0]).collect()}
    assert by_node == {"n1": False, "n2": True, "n3": True}
    by_edge = G.select_nodes_by_edge_property(nodes, edges, "relation", ["0"])
    assert by_edge.columns == ["node", "grp", "x", "hidden"]
    assert {r.node: r.hidden for r in by_edge.collect()} == {"n1": False, "n2": False, "n3": True}


def test_attribution_isolates_failing_variants(spark):
    class Brittle:  # local, so that it travels to the tasks by value
        def __call__(self, texts):
            if any("boom" not in t for t in texts):
                raise ValueError("variant without boom")
            return S.VowelLengthPredictor()(texts)

    df = spark.createDataFrame([(1, "boom aaa eee xyz")], "id int, text string")
    got = S.loo_attribution(df, Brittle, ["id"]).collect()
    assert sorted(r.token for r in got) == ["aaa", "eee", "xyz"]  # the variant without "boom" has no weight


def test_sampled_attribution_solves_one_system_per_sample_count():
    import pandas as pd

    rng = np.random.default_rng(0)
    masks, T_ = rng.integers(0, 2, (24, 40)), 40
    masks[0] = 1
    y = rng.random(24)
    pdf = pd.DataFrame({"id": 1, "_toks": [[f"t{i}" for i in range(T_)]] + [None] * 23, "_mask": list(masks), "p_positive": y})
    got = S._fit_surrogate(["id"], T_, 25.0, 1.0)(pdf).sort_values("pos")["weight"].to_numpy()
    X = masks.astype(float)
    cos = X.sum(1) / (np.sqrt(X.sum(1)) * np.sqrt(T_))
    w = np.sqrt(np.exp(-(((1 - cos) * 100) ** 2) / 25.0 ** 2))
    Xc = np.column_stack([np.ones(24), X])
    A = Xc.T @ (Xc * w[:, None]) + np.diag([0.0] + [1.0] * T_)
    assert np.allclose(got, np.linalg.solve(A, Xc.T @ (y * w))[1:], atol=1e-8)


def test_required_fields_name_the_item(spark):
    df = spark.createDataFrame([(1, "a", "3"), (2, None, "x")], "id int, text string, label string")
    got = {(r.field, r.item, r.problem) for r in P.invalid_rows(df, ["text", "label", "gone"], ["id"], {"label": "int"}).collect()}
    assert got == {("text", '{"id":2}', "missing"), ("label", '{"id":2}', "bad type"),
                   ("gone", '{"id":1}', "missing"), ("gone", '{"id":2}', "missing")}
    with pytest.raises(ValueError, match="'text' missing in item .*\"id\":2"):
        P.validate_required(df, ["text"], strict=True)


def test_nothing_is_cut_by_default(spark):
    rows = [(b, i, 0, f"source {i}", "causes", "target x", 1.0) for b in range(3) for i in range(5)]
    t = spark.createDataFrame(rows, "batch_id long, line_no long, line_idx int, source_concept string, "
                                    "relation_type string, target_concept string, weight double")
    order = ["batch_id", "line_no", "line_idx"]
    assert T.first_n_distinct(t, order).count() == 5 and T.first_n_distinct(t, order, 2).count() == 2
    assert [tuple(r) for r in T.ingest_progress(t, "batch_id", order).orderBy("batch_id").collect()] == [
        (0, 5, 5, 5, False), (1, 5, 0, 5, False), (2, 5, 0, 5, False)]
    assert [tuple(r) for r in T.ingest_progress(t, "batch_id", order, 3).orderBy("batch_id").collect()] == [
        (0, 5, 3, 3, True), (1, 5, 0, 3, True), (2, 5, 0, 3, True)]


def test_top_k_over_several_blocks_equals_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(60)] + [(60, [0.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 7 = 0")
    one = sorted(map(tuple, V.top_k_cosine(v, q, 4).select("query_id", "rank", "id").collect()))
    many = sorted(map(tuple, V.top_k_cosine(v, q, 4, chunk_rows=9, n_pivots=3).select("query_id", "rank", "id").collect()))
    assert one == many and len(one) == 9 * 4


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from textlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_lookups_start_no_job_while_they_are_built(spark):
    df = spark.createDataFrame([(1, "lol good")], "doc_id int, text string")
    terms = spark.createDataFrame([("good", "x")], "term string, explanation string")
    lexicon = spark.createDataFrame([("good", 0.5, 0.1)], "word string, positive double, negative double")
    slang = spark.createDataFrame([("lol", "laughing")], "slang string, expansion string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "none expected")
    try:
        E.lookup_explanations(df, terms, ent_col="text")
        K.lexicon_sentiment(df, lexicon)
        K.slang_expand(df, slang)
        E.insert_ignore(terms, terms, "term", ["explanation"])
        P.relation_filter(df.withColumn("rel", F.col("text")), terms)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
