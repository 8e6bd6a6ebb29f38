"""Run queries with Spark's event log on and report task balance per stage.

    python tools/stage_balance.py [--sf DIR] [--log-dir DIR] name [name ...]

The event log goes to a fresh folder (``--log-dir`` or a new temporary
folder).  For every stage with several tasks the report shows task count,
slowest and median task time, and slowest / median records read: a skewed
key shows up as a large ratio.
"""

from __future__ import annotations

import argparse
import collections
import glob
import io
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def report(log_dir: str, min_tasks: int = 2) -> list[tuple]:
    tasks = collections.defaultdict(list)
    group = {}
    for f in sorted(glob.glob(f"{log_dir}/**/events_*", recursive=True) + glob.glob(f"{log_dir}/local-*")):
        for ln in _lines(f):
            e = json.loads(ln)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for s in e.get("Stage IDs", []):
                    group[s] = g
            elif ev == "SparkListenerTaskEnd":
                i, m = e["Task Info"], e.get("Task Metrics") or {}
                rec = (m.get("Input Metrics") or {}).get("Records Read", 0) + \
                    (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks[e["Stage ID"]].append((i["Finish Time"] - i["Launch Time"], rec))
    rows = []
    for s, ts in sorted(tasks.items()):
        if len(ts) < min_tasks:
            continue
        d, r = [t[0] for t in ts], [t[1] for t in ts]
        med_r = statistics.median(r)
        rows.append((group.get(s) or "-", s, len(ts), max(d), int(statistics.median(d)),
                     (max(r) / med_r) if med_r else float("nan")))
    return rows


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--log-dir", default=None)
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    log_dir = a.log_dir or tempfile.mkdtemp(prefix="run-")
    from textlens.plans.registry import queries
    from textlens.session import get_session

    spark = get_session(**{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    for n in a.names:
        spark.sparkContext.setJobGroup(n, n)
        queries()[n](spark, a.sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    print(f"event log: {log_dir}")
    print(f"{'query':28s} {'stage':>5s} {'tasks':>5s} {'max ms':>7s} {'med ms':>7s} {'max/med records':>15s}")
    for g, s, n, mx, med, ratio in report(log_dir):
        print(f"{g:28s} {s:5d} {n:5d} {mx:7d} {med:7d} {ratio:15.2f}")


if __name__ == "__main__":
    main()
