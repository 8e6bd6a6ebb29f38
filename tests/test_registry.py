"""The registry, the driver contract and INVENTORY.md stay in sync."""

import os
import re

import __spark_entry__ as entry
from textlens.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_is_in_the_inventory():
    inv = open(os.path.join(ROOT, "INVENTORY.md"), encoding="utf-8").read()
    listed = set(re.findall(r"\b([a-z][a-z0-9]*_[a-z0-9_]+)\b", inv))
    missing = sorted(set(registry.queries()) - listed)
    assert not missing, missing


def test_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    for name, sql in o.items():
        assert sql.strip() and not re.search(r"\{[a-z_]{2,}\}", sql), name  # no unformatted placeholder


def test_survey_ids_covered():
    inv = open(os.path.join(ROOT, "INVENTORY.md"), encoding="utf-8").read()
    ids = set(re.findall(r"^\| ([SPTJAWLURM]\d\d) \|", inv, flags=re.M))
    expected = ({f"S{i:02d}" for i in range(1, 12)} | {f"P{i:02d}" for i in range(1, 16)} | {"T01"}
                | {f"J{i:02d}" for i in range(1, 12)} | {f"A{i:02d}" for i in range(1, 16)}
                | {f"W{i:02d}" for i in range(1, 7)} | {f"L{i:02d}" for i in range(1, 6)}
                | {"U01", "U02", "R01", "R02"} | {f"M{i:02d}" for i in range(1, 9)})
    assert ids == expected
