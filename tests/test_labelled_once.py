"""Labelled rows of the training queries are computed once."""

from textlens.plans import q_models


def test_labelled_rows_are_read_back(spark, capsys):
    data = q_models._labelled(spark, "/root/testdata/sf0.001")
    capsys.readouterr()
    data.explain()
    plan = capsys.readouterr().out
    assert all("textlens-labelled" in f for f in data.inputFiles()) and "Join" not in plan and "Generate" not in plan
