"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully computed with the ``noop`` sink (no driver collect);
prints one JSON line with the per-query wall times and their sum.

    BENCH_SF_DIR=/root/testdata/sf0.01 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a10_knowledge_features",
    "j02_lexicon_sentiment",
    "p03_clean_text",
    "p14_token_window",
    "t01_parse_triples",
    "w03_first_n_distinct",
    "a15_ingest_progress",
    "w01_merge_spans",
    "l01_sorted_vocab",
    "p15_entity_slots",
    "j01_lookup_explanations",
    "j06_entity_candidates",
    "a08_relation_importance",
    "w02_top_concept",
    "j05_concept_neighbours",
    "j09_two_hop_classes",
    "a04_classification_report",
    "a05_roc_auc",
    "m08_exact_split",
    "m01_score_texts",
    "m07_token_attribution",
    "j08_cosine_pairs",
    "p01_dialogue_text",
    "s03_read_labeled_csv",
    "r02_stream_request_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from textlens.plans.registry import queries
    from textlens.session import get_session

    spark = get_session(f"local[{cpus}]", app="textlens-bench",
                        **{"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    qs = queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report, keep measuring the others
            times[name] = None
            errors[name] = f"{type(e).__name__}: {e}"[:300]
    spark.stop()
    sf = os.path.basename(sf_dir).removeprefix("sf")
    out = {"metric": "headline_queries_total_wall", "value": round(sum(t for t in times.values() if t), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
