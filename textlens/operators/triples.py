"""Knowledge triples from free text (T01), first-N de-duplication (W03),
ingestion progress (A15) and the append-only triple sink (S08).

Parsing is a chain of column expressions plus one ``posexplode`` of the
lines of each text: no Python, no shuffle.  De-duplication is a hash
aggregate per key (``min_by`` arrival) followed by a bounded top-N.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import WS, WORD, py_strip
from textlens.operators.prep import TRIPLE_RELATIONS, safe_cast
from textlens.plans.prefix import running_sums
from textlens.session import materialize

# Generator target (passed by callers who want it; nothing is cut
# by default), weight range and minimum lengths of T01/W03.
TARGET_COUNT = 10_000
WEIGHT_MIN, WEIGHT_MAX = 0.5, 2.5
MIN_LINE_CHARS = 10
MIN_CONCEPT_CHARS = 2

# Non-data content removed before line parsing (multi-line
# mode; only "\n" ends a line): fenced blocks, '#' lines, "Example(s):" and
# "Note:" tails, "word:" prefixes and runs of '*'.
NOISE = rf"(?md)(```[\s\S]*?```|^#.*|Examples?:.*|Note:.*|(?<!{WORD}){WORD}+:{WS}*|\*+)"

TRIPLE_COLS = ["source_concept", "relation_type", "target_concept", "weight"]


def _concept(c: Column) -> Column:
    return F.lower(F.replace(py_strip(c), F.lit(" "), F.lit("_")))


def parse_triples(df: DataFrame, raw_col: str, keep: Sequence[str] = (),
                  allowed: Sequence[str] = TRIPLE_RELATIONS, lo: float = WEIGHT_MIN,
                  hi: float = WEIGHT_MAX) -> DataFrame:
    """0..n validated ``(source, relation, target, weight)`` rows per text.

    ``keep`` columns are carried (e.g. arrival order); ``line_idx`` is the
    0-based line position inside the text.
    """
    clean = F.regexp_replace(F.col(raw_col), NOISE, "")
    lines = df.select(*keep, F.posexplode(F.split(clean, "\n")).alias("line_idx", "_l"))
    lines = lines.select(*keep, "line_idx", py_strip("_l").alias("_l")).where(F.length("_l") >= MIN_LINE_CHARS)
    l2 = F.regexp_replace("_l", f"{WS}{{2,}}", ",")
    parts = F.when(F.contains(l2, F.lit('","')),
                   F.transform(F.split(l2, '","'), lambda p: F.regexp_replace(p, '^"+|"+$', ""))
                   ).otherwise(F.split(l2, rf"[,|]{WS}*", 4))
    p = lines.select(*keep, "line_idx", parts.alias("_p"))
    w = safe_cast(py_strip(F.get("_p", 3)), "double")
    t = p.where(F.size("_p") == 4).select(
        *keep, "line_idx",
        _concept(F.get("_p", 0)).alias("source_concept"),
        F.lower(py_strip(F.get("_p", 1))).alias("relation_type"),
        _concept(F.get("_p", 2)).alias("target_concept"),
        F.round(w, 1).alias("weight"),
    )
    return t.where(
        F.col("relation_type").isin(list(allowed))
        & F.col("weight").between(lo, hi)
        & (F.length("source_concept") >= MIN_CONCEPT_CHARS)
        & (F.length("target_concept") >= MIN_CONCEPT_CHARS)
    )


def triple_key(df: DataFrame) -> Column:
    return F.concat_ws("|", "source_concept", "relation_type", "target_concept")


def first_arrivals(triples: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """One row per key: the earliest arrival and its weight (hash aggregate,
    partial on the map side, so a repeated hot key costs one row per task)."""
    arr = F.struct(*[F.col(c) for c in order_cols])
    g = triples.groupBy(*TRIPLE_COLS[:3]).agg(
        F.min(F.struct(arr.alias("a"), F.col("weight").alias("w"))).alias("_m"))
    return g.select(*TRIPLE_COLS[:3], F.col("_m.w").alias("weight"),
                    *[F.col(f"_m.a.{c}").alias(c) for c in order_cols])


def first_n_distinct(triples: DataFrame, order_cols: Sequence[str], n: int | None = None) -> DataFrame:
    """The first ``n`` distinct keys (all of them without ``n``) in arrival
    order, each with the weight of its first arrival (W03).  The top-N keeps
    at most ``n`` rows per task."""
    firsts = first_arrivals(triples, order_cols).orderBy(*order_cols, *TRIPLE_COLS[:3])
    return firsts if n is None else firsts.limit(n)


def ingest_progress(triples: DataFrame, batch_col: str, order_cols: Sequence[str],
                    n: int | None = None) -> DataFrame:
    """Per batch: parsed rows, rows newly added (first arrivals, up to the
    target ``n``), and the running total of added rows (A15).

    One aggregate finds the first arrival of each key, one counts per batch;
    the running total is a distributed prefix sum over one row per batch, and
    the target cuts that total: the rows within it are the first in arrival
    order, because batches arrive in ``batch_col`` order."""
    if list(order_cols)[0] != batch_col:
        raise ValueError("arrival order starts with the batch")
    arr = F.struct(*[F.col(c) for c in order_cols])
    per_key = triples.groupBy(batch_col, *TRIPLE_COLS[:3]).agg(F.min(arr).alias("_a"), F.count(F.lit(1)).alias("_n"))
    # per key the counts of its batches, so one table gives parsed and added
    both = per_key.groupBy(*TRIPLE_COLS[:3]).agg(
        F.min("_a").alias("_first"), F.collect_list(F.struct(F.col(batch_col).alias("b"), F.col("_n").alias("n"))).alias("_b"))
    each = both.select(F.col(f"_first.{batch_col}").alias("_home"), F.explode("_b").alias("_e"))
    per = materialize(each.groupBy(F.col("_e.b").alias(batch_col)).agg(
        F.sum("_e.n").alias("parsed"), F.count_if(F.col("_home") == F.col("_e.b")).alias("added")))
    run = running_sums(per, batch_col, ["added"])
    total = F.col("cum_added")
    if n is None:
        return run.select(batch_col, "parsed", "added", total.alias("total"), F.lit(False).alias("target_reached"))
    before = F.least(total - F.col("added"), F.lit(n))
    capped = F.least(total, F.lit(n))
    return run.select(batch_col, "parsed", (capped - before).alias("added"), capped.alias("total"),
                      (capped >= n).alias("target_reached"))
