"""Summarise the physical plan of registered queries as Markdown.

    python tools/plan_summary.py [--sf DIR] [name ...] > PLANS.md

For each query: scans (table, read schema, pushed filters), shuffle
exchanges, join strategies, aggregates and window group limits, counted from
the static physical plan (AQE is switched off only for this listing so the
plan is shown before runtime re-planning).
"""

from __future__ import annotations

import argparse
import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["a10_knowledge_features", "p03_clean_text", "t01_parse_triples", "w03_first_n_distinct",
           "w01_merge_spans", "p15_entity_slots", "j06_entity_candidates", "j05_concept_neighbours",
           "j09_two_hop_classes", "a05_roc_auc", "m08_exact_split", "m06_select_checkpoint", "j08_cosine_pairs",
           "m01_score_texts", "m07_token_attribution"]


def walk(node):
    yield node
    for i in range(node.children().size()):
        yield from walk(node.children().apply(i))
    # subqueries / reused nodes are not followed


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from textlens.plans.registry import queries
    from textlens.session import get_session

    spark = get_session(**{"spark.sql.adaptive.enabled": "false"})
    qs = queries()
    print("# PLANS — static physical plans of headline queries\n")
    print(f"Generated by `tools/plan_summary.py` at `{a.sf}` (AQE off for the listing only; at run time AQE")
    print("may further turn sort-merge joins into broadcast joins and coalesce partitions).\n")
    for name in a.names or DEFAULT:
        df = qs[name](spark, a.sf)
        plan = df._jdf.queryExecution().executedPlan()
        kinds = collections.Counter()
        scans = []
        for n in walk(plan):
            k = n.nodeName()
            if k.startswith("Scan") or "FileScan" in k or k == "FileSourceScanExec":
                s = n.toString()
                tbl = re.search(r"/([a-z_]+)\.parquet", s)
                rs = re.search(r"ReadSchema: (struct<[^>]*>)", s)
                pf = re.search(r"PushedFilters: \[([^\]]*)\]", s)
                if tbl is None:
                    scans.append(("(materialised checkpoint / local rows)", "", ""))
                    continue
                scans.append((tbl.group(1), rs.group(1) if rs else "", pf.group(1) if pf else ""))
            else:
                kinds[k] += 1
        print(f"## {name}\n")
        ex = kinds.get("Exchange", 0)
        bex = kinds.get("BroadcastExchange", 0)
        joins = {k: v for k, v in kinds.items() if "Join" in k}
        wgl = kinds.get("WindowGroupLimit", 0)
        aggs = {k: v for k, v in kinds.items() if "Aggregate" in k}
        print(f"* shuffle exchanges: {ex}; broadcast exchanges: {bex}; reused exchanges: {kinds.get('ReusedExchange', 0)}")
        print(f"* joins: {dict(sorted(joins.items())) or '—'}")
        print(f"* aggregates: {dict(sorted(aggs.items())) or '—'}; window group limits: {wgl}; "
              f"windows: {kinds.get('Window', 0)}; python: "
              f"{sum(v for k, v in kinds.items() if 'Python' in k or 'Pandas' in k or 'Arrow' in k)}")
        seen = set()
        for t, rs, pf in scans:
            if (t, rs, pf) in seen:
                continue
            seen.add((t, rs, pf))
            if not rs:
                print(f"* scan {t}")
                continue
            print(f"* scan `{t}`: read `{rs}`" + (f", pushed `{pf}`" if pf else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
