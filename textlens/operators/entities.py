"""Tagged spans -> phrases -> explanations.

W01 is a gaps-and-islands window per text: the window, the island grouping
and the per-text distinct all need the data clustered by text only, so the
plan has one shuffle.  Lookups join against the term table; the planner or
adaptive execution broadcasts it where it is measured small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.plans.prefix import dense_ranks

# Phrase filters of the span merger and the slot layout.
MIN_MEAN_SCORE = 0.85
MAX_PARTS = 3
MIN_PHRASE_CHARS, MAX_PHRASE_CHARS = 3, 40
UNKNOWN = "[UNK]"
N_SLOTS = 5


# ---------------------------------------------------------------- W01
def _kept_phrases(g: DataFrame, doc: str) -> DataFrame:
    kept = g.where((F.col("mean_score") > MIN_MEAN_SCORE) & (F.col("n_parts") <= MAX_PARTS)
                   & F.length("phrase").between(MIN_PHRASE_CHARS, MAX_PHRASE_CHARS))
    return kept.groupBy(doc, "phrase").agg(F.max("mean_score").alias("score"))


def merge_spans(spans: DataFrame, doc: str = "doc_id", start: str = "span_start", end: str = "span_end",
                word: str = "word", score: str = "score", order: Sequence[str] = ()) -> DataFrame:
    """Adjacent spans (start == previous end) form one phrase; ``##`` word
    pieces are joined; a phrase is kept when its mean score > 0.85, it has
    at most 3 parts and its text is 3..40 characters.  Output: distinct
    ``(doc, phrase)`` with the best mean score of that phrase in the text.

    Spans of a text are taken in ``order`` (default: start, end).  A span
    without a start or an end never breaks a phrase, and an absent end counts
    as 0 for the span behind it.  The mean is the left fold of the part scores
    in that order.

    A gaps-and-islands window per text: the window, the islands and the
    distinct all need the data clustered by text only, so there is one
    shuffle; the spans of one text are one task's work.
    """
    by = [F.col(c) for c in order] or [F.col(start), F.col(end)]
    w = Window.partitionBy(doc).orderBy(*by)
    last = F.lag(F.coalesce(F.col(end), F.lit(0))).over(w)
    placed = F.col(start).isNotNull() & F.col(end).isNotNull()
    brk = F.when(last.isNull() | (placed & (F.col(start) != last)), 1).otherwise(0)
    marked = spans.select("*", brk.alias("_brk"), F.row_number().over(w).alias("_at"))
    isl = marked.withColumn("_isl", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = isl.groupBy(doc, "_isl").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_at").alias("s"), F.replace(F.col(word), F.lit("##"), F.lit("")).alias("w"),
        F.col(score).cast("double").alias("p")))).alias("_parts"))
    g = g.select(
        doc,
        (F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["p"]) / F.size("_parts")).alias("mean_score"),
        F.size("_parts").alias("n_parts"),
        F.array_join(F.transform("_parts", lambda x: x["w"]), " ").alias("phrase"),
    )
    return _kept_phrases(g, doc)


# ---------------------------------------------------------------- L01
def sorted_vocab(phrases: DataFrame, col: str = "phrase") -> DataFrame:
    """All distinct phrases in code-point order (a distributed range sort)."""
    return phrases.select(F.col(col).alias("term")).distinct().orderBy("term")


def numbered_vocab(phrases: DataFrame, col: str = "phrase") -> DataFrame:
    """``(id, term)``: all distinct phrases, numbered 1, 2, ... without a gap in code-point order."""
    terms = phrases.select(F.col(col).alias("term")).where(F.col("term").isNotNull()).distinct()
    return dense_ranks(terms, "term", "id").select("id", "term")


# ---------------------------------------------------------------- J01
def _term_index(terms: DataFrame, mode: str, term: str, expl: str, order_col: str | None = None) -> DataFrame:
    if mode == "casefold":
        # One explanation per case-folded key: the latest arrival wins when an
        # order column is given, else the smallest stored spelling.
        pick = (F.max_by(F.col(expl), F.col(order_col)) if order_col
                else F.min_by(F.col(expl), F.col(term)))
        return terms.groupBy(F.lower(term).alias("_key")).agg(pick.alias("_expl"))
    if mode == "exact":
        return terms.select(F.col(term).alias("_key"), F.col(expl).alias("_expl"))
    raise ValueError(f"unknown mode {mode!r}")


def lookup_explanations(ents: DataFrame, terms: DataFrame, ent_col: str = "entity", mode: str = "casefold",
                        term: str = "term", expl: str = "explanation", out_col: str = "explanation",
                        order_col: str | None = None) -> DataFrame:
    """entity -> explanation or ``[UNK]``.  ``casefold`` compares lower case on
    both sides; ``exact`` compares lower(entity) with the key as stored (so
    capitalised keys never match, as in the source system)."""
    idx = _term_index(terms, mode, term, expl, order_col)
    j = ents.join(idx, F.lower(F.col(ent_col)) == F.col("_key"), "left")
    return j.select(*[ents[c] for c in ents.columns], F.coalesce("_expl", F.lit(UNKNOWN)).alias(out_col))


# ---------------------------------------------------------------- J07
def new_keys(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to add: first row (by ``order``) of each key that is
    absent from ``existing``."""
    cols = existing.columns
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in cols if c != key]),
                                          F.struct(*order)).alias("_r"))
    first = first.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != key])
    return first.join(existing.select(key), key, "left_anti").select(*cols)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``INSERT OR IGNORE``: rows of ``new`` whose key is absent from
    ``existing`` are added; inside the batch the first row (by ``order``)
    of each key wins."""
    return existing.unionByName(new_keys(existing, new, key, order))


# ---------------------------------------------------------------- P15
def entity_slots(docs: DataFrame, phrases: DataFrame, terms: DataFrame, doc: str = "doc_id",
                 k: int = N_SLOTS, mode: str = "casefold") -> DataFrame:
    """The first ``k`` phrases of each text (score desc, phrase asc) and
    their explanations in fixed slots; empty slots are ``''``, unknown
    explanations ``[UNK]``; ``valid`` marks filled slots.

    ``row_number() <= k`` becomes a WindowGroupLimit: each map task keeps at
    most ``k`` rows per text before the shuffle.
    """
    w = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("phrase").asc())
    top = phrases.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    top = lookup_explanations(top, terms, ent_col="phrase", mode=mode)
    g = top.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_rank", "phrase", "explanation"))).alias("_s"))
    full = docs.select(doc).distinct().join(g, doc, "left").select(
        doc, F.coalesce("_s", F.array().cast(g.schema["_s"].dataType)).alias("_s"))
    n = F.size("_s")
    pad = F.array_repeat(F.lit(""), F.lit(k) - n)
    return full.select(
        doc,
        F.concat(F.transform("_s", lambda s: s["phrase"]), pad).alias("entities"),
        F.concat(F.transform("_s", lambda s: s["explanation"]), pad).alias("explanations"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(k) - n)).alias("valid"),
    )
