"""Candidate search: work follows the rows, not the size of a file that compresses well."""

from __future__ import annotations

from textlens.operators import kb as KB
from textlens.plans import sizing


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_matches_are_dealt_over_tasks_and_names_are_not_broadcast(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(KB, "tasks_for", lambda df: sizing.tasks_for(df, 100))
    path = str(tmp_path / "entities")
    spark.range(700).selectExpr("concat('Q', id) AS qid", "concat('red bolt ', id % 3) AS label", "'a red thing' AS description"
                                ).coalesce(1).write.parquet(path)
    ents = spark.read.parquet(path)
    terms = spark.createDataFrame([("red bolt 1",), ("BOLT",), ("blue",), ("ed",)], "term STRING")
    matches = KB.candidate_matches(terms, ents.selectExpr("qid", "label AS name"))
    ranked = KB.rank_candidates(matches, ents)
    plan = _plan(ranked, capsys)
    assert "hashpartitioning(qid" in plan and ", 7)" in plan
    assert plan.count("BroadcastExchange") <= 2  # the gram sizes, at most three rows
    got = {}
    for r in ranked.collect():
        got.setdefault(r.term, []).append((r["rank"], r.qid, r.exact_match))
    ids = sorted(f"Q{i}" for i in range(700))
    assert [q for _, q, _ in sorted(got["BOLT"])] == ids[:10] == [q for _, q, _ in sorted(got["ed"])]
    assert sorted(got["red bolt 1"]) == [(k, q, 1) for k, q in enumerate([q for q in ids if int(q[1:]) % 3 == 1][:10], 1)]
    assert "blue" not in got


def test_matches_of_repeated_null_and_shared_names(spark):
    names = spark.createDataFrame([("Q1", "Ab"), ("Q1", "Ab"), ("Q1", "aB"), (None, "xab"), ("Q2", None), ("Q3", "abab"), ("Q4", "")],
                                  "qid STRING, name STRING")
    terms = spark.createDataFrame([("ab",), ("ab",), ("",), (None,), ("B",)], "term STRING")
    got = sorted(map(tuple, KB.candidate_matches(terms, names).collect()), key=str)
    want = [(t, q, n) for t in ("ab", "B") for q, n in (("Q1", "Ab"), ("Q1", "aB"), (None, "xab"), ("Q3", "abab"))]
    # a name without a key is no match
    assert got == sorted([w for w in want if w[1] is not None], key=str), got
