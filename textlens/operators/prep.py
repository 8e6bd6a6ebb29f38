"""Corpus preparation: projections, predicates, validation and splits
(P01-P14, M08, U01, A13, J11).

All row-level work is built-in column expressions; the only aggregations are
per-conversation (P01, bounded by one dialogue) and count reports.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import clean_text, py_strip, ws_tokens
from textlens.plans.prefix import global_rank
from textlens.session import materialize


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- P01 / P02
def dialogue_text(context, response) -> Column:
    """``' '.join(context) + ' ' + response`` (an empty context leaves the
    leading space; ``concat_ws`` would drop it)."""
    return F.concat(F.array_join(_c(context), " "), F.lit(" "), _c(response))


def binarize_label(col, positive: str = "SARCASM") -> Column:
    """1 iff the label equals ``positive`` exactly, else 0 (NULL -> 0)."""
    return F.when(_c(col).eqNullSafe(F.lit(positive)), 1).otherwise(0)


def dialogues_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
                         is_response: str = "is_response", label: str = "label",
                         positive: str = "SARCASM") -> DataFrame:
    """Long turn rows -> one ``(conv, text, label)`` row per dialogue.  The
    grouping is per conversation, whose size is bounded by one dialogue."""
    g = turns.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.when(~F.col(is_response), F.struct(F.col(turn), F.col(text))))).alias("_ctx"),
        F.max(F.when(F.col(is_response), F.col(text))).alias("_resp"),
        F.max(label).alias("_label"),
    )
    return g.select(
        conv,
        dialogue_text(F.transform("_ctx", lambda s: s[text]), F.col("_resp")).alias("text"),
        binarize_label("_label", positive).alias("label"),
    )


# ---------------------------------------------------------------- P03 / P04
def clean_texts(df: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """P03 + P04: drop NULL texts, clean, drop texts that become empty."""
    return (df.where(F.col(text_col).isNotNull())
              .withColumn(out_col, clean_text(text_col))
              .where(F.col(out_col) != ""))


# ---------------------------------------------------------------- P05
# Emotion label groups and threshold of the flag columns.
EMOTION_GROUPS = {
    "hostile_label": ("anger", "annoyance", "disgust"),
    "contempt_label": ("disapproval", "disappointment"),
    "humor_label": ("amusement", "joy", "excitement"),
}
EMOTION_THRESHOLD = 0.5


def emotion_flags(df: DataFrame, label: str = "label", score: str = "score",
                  groups: Mapping[str, Sequence[str]] = EMOTION_GROUPS,
                  threshold: float = EMOTION_THRESHOLD) -> DataFrame:
    """One 0/1 column per group: top-1 label in the group and score strictly
    above the threshold.  A missing scorer result (NULL) gives 0."""
    return df.select("*", *[
        F.coalesce(F.when(F.col(label).isin(list(v)) & (F.col(score) > threshold), 1).otherwise(0),
                   F.lit(0)).alias(k)
        for k, v in groups.items()])


# ---------------------------------------------------------------- P06
def label_vector(df: DataFrame, cols: Sequence[str], out_col: str = "labels") -> DataFrame:
    return df.withColumn(out_col, F.array(*[F.col(c).cast("int") for c in cols]))


def split_label_vector(df: DataFrame, names: Sequence[str], col: str = "labels") -> DataFrame:
    return df.select("*", *[F.get(F.col(col), i).alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------- P07
# Relation allow-lists of the concept graph and the triple generator.
GRAPH_RELATIONS = ("antonym", "related_to", "synonym", "is_a", "has_a", "part_of", "used_for",
                   "causes", "has_property", "at_location", "form_of")
TRIPLE_RELATIONS = ("antonym", "not_has_property", "not_used_for", "causes", "has_context",
                    "entails", "obstructed_by")


def relation_filter(df: DataFrame, allowed: Sequence[str] | DataFrame = GRAPH_RELATIONS,
                    rel_col: str = "rel") -> DataFrame:
    """Keep rows whose relation is allowed: ``isin`` for a literal list, a
    left-semi join for an allow-list table."""
    if isinstance(allowed, DataFrame):
        a = allowed.select(F.col(allowed.columns[0]).alias("_rel")).distinct()
        return df.join(a, F.col(rel_col) == F.col("_rel"), "left_semi")
    return df.where(F.col(rel_col).isin(list(allowed)))


# ---------------------------------------------------------------- P08
def validate_required(df: DataFrame, fields: Sequence[str], types: Mapping[str, str] | None = None,
                      strict: bool = False) -> DataFrame:
    """One row per required field: present in the schema, declared type
    matches, NULL count (one aggregate pass, lazy).  ``strict`` raises on the
    first problem, naming the field and the first offending item."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = dict(types or {})

    def type_ok(f: str) -> bool:
        return f in have and (f not in types or have[f] == types[f])

    if strict:
        for f in fields:
            if not type_ok(f):
                raise ValueError(f"field '{f}': present={f in have}, type={have.get(f)}, expected {types.get(f)}")
        bad = invalid_rows(df, fields).limit(1).collect()
        if bad:
            raise ValueError(f"field '{bad[0]['field']}' missing in item {bad[0]['item']}")
    checks = F.array(*[F.struct(
        F.lit(f).alias("field"), F.lit(f in have).alias("present"), F.lit(type_ok(f)).alias("type_ok"),
        (F.count_if(F.col(f).isNull()) if f in have else F.lit(None).cast("long")).alias("n_null")) for f in fields])
    return df.agg(checks.alias("_c")).select(F.inline("_c"))


def invalid_rows(df: DataFrame, fields: Sequence[str], id_cols: Sequence[str] = (),
                 types: Mapping[str, str] | None = None) -> DataFrame:
    """``(field, item, problem)``: every missing or ill-typed required field of
    every row; ``item`` is the row's id columns (all its columns without any)
    as JSON.  ``types`` are checked per item: a value that does not cast to
    the declared type is ``bad type``."""
    item = F.to_json(F.struct(*(list(id_cols) or df.columns)))
    types = dict(types or {})

    def problem(f: str) -> Column:
        if f not in df.columns:
            return F.lit("missing")
        bad = F.when(F.col(f).isNull(), "missing")
        return bad.when(safe_cast(f, types[f]).isNull(), "bad type") if f in types else bad

    found = F.array(*[F.struct(F.lit(f).alias("field"), problem(f).alias("problem")) for f in fields])
    return df.select(item.alias("item"), F.explode(found).alias("p")).where("p.problem is not null").select(
        "p.field", "item", "p.problem")


# ---------------------------------------------------------------- P09
_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
_NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_cast(col, to: str) -> Column:
    """Cast that yields NULL instead of failing (ANSI mode), accepting only
    plain decimal spellings (Spark alone would also accept ``1.5d``)."""
    c = _c(col).cast("string")
    if to in ("int", "bigint", "long", "smallint"):
        return F.when(c.rlike(_INT_RE), F.trim(c).try_cast(to))
    if to in ("double", "float"):
        return F.when(c.rlike(_NUM_RE), F.trim(c).try_cast(to))
    return c.try_cast(to)


def quarantine_rows(df: DataFrame, rules: Mapping[str, str], default: Mapping[str, object] | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Cast each ruled column; rows where a non-NULL input fails are ``bad``.
    With ``default`` a failed or missing value is replaced instead (the
    inference path: a missing label becomes -1)."""
    default = dict(default or {})
    cast = df.select("*", *[safe_cast(c, t).alias(f"_q_{c}") for c, t in rules.items()])
    fails = [F.col(c).isNotNull() & F.col(f"_q_{c}").isNull() for c in rules if c not in default]
    bad_flag = F.lit(False)
    for f in fails:
        bad_flag = bad_flag | f
    out = cast.select(*[c for c in df.columns if c not in rules],
                      *[(F.coalesce(F.col(f"_q_{c}"), F.lit(default[c]).cast(t)) if c in default
                         else F.col(f"_q_{c}")).alias(c) for c, t in rules.items()],
                      bad_flag.alias("_bad"),
                      *[F.col(c).alias(f"_raw_{c}") for c in rules])
    good = out.where(~F.col("_bad")).drop("_bad", *[f"_raw_{c}" for c in rules])
    bad = out.where(F.col("_bad")).drop("_bad")
    return good, bad


# ---------------------------------------------------------------- P10
_FIELD = re.compile(r"\{(\w+)\}")


def render_prompt(template: str, **cols) -> Column:
    """Fill ``{name}`` fields of ``template`` from columns (``format_string``)."""
    names = _FIELD.findall(template)
    fmt = _FIELD.sub("%s", template.replace("%", "%%"))
    return F.format_string(fmt, *[_c(cols.get(n, n)) for n in names])


# ---------------------------------------------------------------- P11 / P12 / P13
def parse_binary_answer(col) -> Column:
    """Stripped answer ``'0'`` -> 0, ``'1'`` -> 1, anything else (or NULL) ->
    0; ``valid`` tells whether the answer was one of the two."""
    s = py_strip(_c(col))
    valid = F.coalesce(s.isin("0", "1"), F.lit(False))
    return F.struct(F.when(s == "1", 1).otherwise(0).alias("value"), valid.alias("valid"))


def keyword_answer(col, keywords: Sequence[str] = ("yes", "sarcastic"), yes: str = "yes", no: str = "no") -> Column:
    low = F.lower(_c(col))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.coalesce(F.contains(low, F.lit(k)), F.lit(False))
    return F.when(hit, yes).otherwise(no)


# The elements an explanation must mention.
EXPLANATION_PARTS = ("literal", "context", "cultural", "sentiment")


def validate_explanation(col, required: Sequence[str] = EXPLANATION_PARTS) -> Column:
    """The response with stripped, non-empty lines if it mentions every
    required word (case-insensitive), else NULL."""
    c = _c(col)
    low = F.lower(c)
    ok = F.lit(True)
    for k in required:
        ok = ok & F.contains(low, F.lit(k))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda l: py_strip(l)), lambda l: l != "")
    return F.when(ok, F.array_join(lines, "\n"))


# ---------------------------------------------------------------- P14
PAD = "[PAD]"


def token_window(df: DataFrame, col: str = "text", max_length: int = 128, pad: str = "max",
                 tokens_col: str = "tokens", mask_col: str = "attention_mask") -> DataFrame:
    """Whitespace tokens cut to ``max_length`` and padded with ``[PAD]`` to
    ``max_length`` (``pad='max'``) or to the longest row (``'longest'``, one
    scalar aggregate); the mask is 1 for real tokens, 0 for padding."""
    toks = F.slice(ws_tokens(col), 1, max_length)
    base = df.withColumn(tokens_col, toks)
    if pad == "longest":
        width = base.agg(F.max(F.size(tokens_col))).first()[0] or 0
    else:
        width = max_length
    n = F.size(tokens_col)
    padn = F.greatest(F.lit(width) - n, F.lit(0))
    return base.select(
        *[c for c in base.columns if c != tokens_col],
        F.concat(F.col(tokens_col), F.array_repeat(F.lit(PAD), padn)).alias(tokens_col),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), padn)).alias(mask_col),
    )


# ---------------------------------------------------------------- M08
def split_hash(id_col: str, seed: int) -> tuple[Column, Column]:
    """(numeric order key, full tie-break) from ``md5(id|seed)``."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), h


def split_cut(ids: DataFrame, id_col: str, fraction: float, seed: int, few: int = 10_000) -> tuple[str, str] | None:
    """The hash and id (as text) of the ``ceil(fraction * n)``-th of ``n``
    different ids in the order of their hash; nothing if there is none.

    The k-th smallest is found by refined histograms: ids are counted by the first
    four hex digits of their hash, then, in the one bin that holds the k-th, by the next
    four, until at most ``few`` are left to be ordered.  The driver sees at most
    65,536 counts a pass, and no id is sorted or sent but for those few."""
    _, full = split_hash(id_col, seed)
    held = materialize(ids.select(F.col(id_col).cast("string").alias("id"), full.alias("h")))
    num, den = Decimal(str(fraction)).as_integer_ratio()  # exact product, no float drift
    k = -(-held.count() * num // den)
    if k <= 0:
        return None
    prefix, left = "", held
    while True:
        digits = len(prefix) + 4
        bins = left.groupBy(F.substring("h", 1, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(bins, key=lambda r: r.bin):
            if k <= r.n:
                prefix = r.bin
                break
            k -= r.n
        left = held.where(F.col("h").startswith(prefix))
        if r.n <= few or digits >= 32:
            last = left.orderBy("h", "id").limit(k).collect()[-1]
            return last.h, last.id


def exact_split(df: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42,
                split_col: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """Deterministic exact split: of the ``n`` different ids the
    ``ceil(fraction * n)`` first in the order of ``md5(id|seed)`` (then of the
    id as text) are ``test``, the rest ``train``; rows of one id stay together.
    Rows with a null id are ``train``.

    One cut value decides, so the split is a comparison in each row: no
    column of ``df`` but the ids is read to find it, and nothing is joined.  With
    ``by`` each group is split on its own; the groups' cut values, one row each,
    are joined by group."""
    by = list(by)
    key, full = split_hash(id_col, seed)
    ids = df.where(F.col(id_col).isNotNull()).select(*by, id_col).distinct()
    if not by:
        cut = split_cut(ids, id_col, fraction, seed)
        test = F.lit(False)
        if cut is not None:
            test = (full < cut[0]) | ((full == cut[0]) & (F.col(id_col).cast("string") <= cut[1]))
        return df.withColumn(split_col, F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train"))
    ids = materialize(ids.select(*by, id_col, key.alias("_sk"), full.alias("_sh"), F.col(id_col).cast("string").alias("_si")))
    num, den = Decimal(str(fraction)).as_integer_ratio()
    ranked = global_rank(ids, "_sk", tie_cols=["_sh", "_si"], by=by, name="_rank")
    ranked = ranked.join(ids.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    test = (F.col("_rank") - 1) * den < F.col("_n") * num  # rank <= ceil(n * num / den), in integers
    cuts = ranked.where(test).groupBy(*by).agg(F.max(F.struct("_sh", "_si")).alias("_cut"))
    mine = F.struct(full.alias("_sh"), F.col(id_col).cast("string").alias("_si"))
    return df.join(cuts, by, "left").select(
        *df.columns, F.when(F.coalesce(F.col(id_col).isNotNull() & (mine <= F.col("_cut")), F.lit(False)), "test")
        .otherwise("train").alias(split_col))


def split_frames(df: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42):
    s = exact_split(df, id_col, fraction, seed)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


# ---------------------------------------------------------------- U01 / A13
def union_datasets(frames: Mapping[str, DataFrame], dataset_col: str = "dataset") -> DataFrame:
    """One table from several corpora, tagged by name, so one job enriches all."""
    out = None
    for name, f in frames.items():
        t = f.withColumn(dataset_col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def split_sizes(df: DataFrame, by: Sequence[str] = ("dataset", "split")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- J11
def align_predictions(src: DataFrame, pred: DataFrame, id_col: str) -> DataFrame:
    """Predictions next to their source rows by id (never by position)."""
    return src.join(pred, id_col, "inner")


def alignment_report(src: DataFrame, pred: DataFrame, id_col: str) -> DataFrame:
    """Counts of source ids, predicted ids, matches, ids predicted twice and
    source ids without a prediction (one full outer join on the id)."""
    s = src.groupBy(id_col).agg(F.count(F.lit(1)).alias("_ns"))
    p = pred.groupBy(id_col).agg(F.count(F.lit(1)).alias("_np"))
    j = s.join(p, id_col, "full")
    return j.agg(
        F.count_if(F.col("_ns").isNotNull()).alias("n_src_ids"),
        F.count_if(F.col("_np").isNotNull()).alias("n_pred_ids"),
        F.count_if(F.col("_ns").isNotNull() & F.col("_np").isNotNull()).alias("n_matched"),
        F.count_if(F.col("_np") > 1).alias("n_dup_pred"),
        F.count_if(F.col("_ns").isNotNull() & F.col("_np").isNull()).alias("n_missing"),
        F.count_if(F.col("_ns").isNull()).alias("n_orphan_pred"),
    )
