"""Lexicon, slang and emoji enrichment (J02, J03, J04) and knowledge features (A10).

Texts are lower-cased and stripped first, then tokenised on whitespace
(``str.lower().strip().split()`` semantics).

* Sentiment (J02) works for lexicons of any size: tokens are exploded, joined
  to the lexicon and summed back per text.  Exploded tokens of one text sit in
  one task, so the partial aggregate before the shuffle already reduces them
  to one row per text.
* Slang (J03): a dictionary given as a Python mapping of a few dozen entries
  becomes a literal map evaluated per row with no shuffle; a larger mapping or
  a DataFrame joins the exploded tokens.  Both give the same result.
* Emoji (J04): one alternation of all keys, longest first, finds the matches of
  a text in one pass; replacement and counting use that one list of matches.

A text is identified by its id *and* its content, so copies that share an id
(an id made from the text, for instance) are counted once each, not summed.
Where a dictionary lists a key twice, the smallest value wins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import py_strip, ws_tokens
from textlens.operators.phrases import expand_phrases

KNOWLEDGE_DIM = 192  # fixed value: width of the knowledge feature vector

# The built-in slang dictionary (slang -> expansion).
SLANG = (
    ("lol", "laughing out loud"),
    ("idk", "i don't know"),
    ("tbh", "to be honest"),
    ("imo", "in my opinion"),
    ("goat", "greatest of all time"),
    ("sick", "excellent"),
    ("lit", "exciting"),
    ("fam", "family"),
    ("ngl", "not gonna lie"),
    ("fr", "for real"),
    ("rn", "right now"),
    ("idc", "i don't care"),
    ("gg", "good game"),
    ("dm", "direct message"),
    ("fomo", "fear of missing out"),
)

# The built-in emoji dictionary (emoji -> meanings).
EMOJI = (
    ("🔥", "fire|exciting|excellent"),
    ("😊", "happy|pleased|positive"),
    ("😢", "sad|unhappy|negative"),
    ("👍", "approve|good|positive"),
    ("👎", "disapprove|bad|negative"),
    ("❤️", "love|adore|positive"),
    ("😂", "laughing|amused|positive"),
    ("😡", "angry|mad|negative"),
    ("🙄", "annoyed|skeptical|negative"),
    ("💪", "strong|confident|positive"),
)


def default_slang(spark) -> DataFrame:
    return spark.createDataFrame(list(SLANG), "slang string, expansion string")


def default_emoji(spark) -> DataFrame:
    return spark.createDataFrame(list(EMOJI), "emoji string, meaning string")


def normalized(col) -> Column:
    """``text.lower().strip()``."""
    return py_strip(F.lower(F.col(col) if isinstance(col, str) else col))


def _content(text: Column) -> Column:
    return F.xxhash64(text)


def _unique(dictionary: DataFrame, key: str, val: str) -> DataFrame:
    """``(_tok, _exp)``, one row per key: the smallest value wins."""
    d = dictionary.select(F.col(key).alias("_tok"), F.col(val).alias("_exp")).where("_tok is not null")
    return d.groupBy("_tok").agg(F.min("_exp").alias("_exp")).where("_exp is not null")


# ---------------------------------------------------------------- J02
def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      word_col: str = "word", pos_col: str = "positive", neg_col: str = "negative",
                      carry: tuple[str, ...] = (), order_col: str | None = None) -> DataFrame:
    """Per text: sums of positive and negative lexicon scores of its tokens
    (repeats count, 0.0 when nothing matches).  One row per id (per id and
    text, where an id stands for several texts); copies of a text under one
    id are one text.

    ``carry`` columns (constant per text) ride along the same single pass, so
    a caller needs no second scan and no join back.  The lexicon must have one
    row per word, or give ``order_col``: the last entry per word (largest
    order value) wins, as when later entries overwrite earlier ones.
    """
    if order_col is not None:
        last = F.max_by(F.struct(F.col(pos_col).alias("p"), F.col(neg_col).alias("n")), F.col(order_col))
        lexicon = lexicon.groupBy(word_col).agg(last.alias("_s")).select(
            word_col, F.col("_s.p").alias(pos_col), F.col("_s.n").alias(neg_col))
    toks = df.select(F.col(id_col), *carry, _content(F.col(text_col)).alias("_text"),
                     F.posexplode_outer(ws_tokens(normalized(text_col))).alias("_i", "_tok"))
    lex = lexicon.select(F.col(word_col).alias("_tok"), F.col(pos_col).alias("_p"), F.col(neg_col).alias("_n"))
    first = F.col("_i").isNull() | (F.col("_i") == 0)  # exactly one row per copy of a text
    hits = toks.join(lex, "_tok", "left").where(F.col("_p").isNotNull() | first)
    copies = F.count_if(first)
    return hits.groupBy(id_col, "_text").agg(
        F.coalesce(F.sum("_p") / copies, F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum("_n") / copies, F.lit(0.0)).alias("negative"),
        *[F.any_value(c).alias(c) for c in carry],
    ).drop("_text")


# ---------------------------------------------------------------- J03
# A literal map is searched entry by entry on each lookup, so it is used only
# for dictionaries of a few dozen entries; larger ones are joined.
MAP_MAX_ENTRIES = 64


def slang_expand(df: DataFrame, slang: DataFrame | Mapping[str, str], id_col: str = "doc_id", text_col: str = "text",
                 slang_col: str = "slang", expansion_col: str = "expansion",
                 out_col: str = "expanded", count_col: str = "n_slang") -> DataFrame:
    """Replace slang tokens by their expansion, re-join tokens with one space,
    and count the distinct slang tokens found.  Input columns are kept."""
    toks = ws_tokens(normalized(text_col))
    if isinstance(slang, Mapping):
        rows = [(k, v) for k, v in slang.items() if k is not None and v is not None]
        if len(rows) <= MAP_MAX_ENTRIES:
            m = (F.create_map(*[F.lit(x) for r in rows for x in r]) if rows
                 else F.create_map().cast("map<string,string>"))
            known = F.filter(toks, lambda t: F.try_element_at(m, t).isNotNull())
            return df.select(
                "*",
                F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(m, t), t)), " ").alias(out_col),
                F.coalesce(F.size(F.array_distinct(known)), F.lit(0)).alias(count_col))
        slang = df.sparkSession.createDataFrame(rows, f"{slang_col} string, {expansion_col} string")
    # Explode, join, regroup per (id, text) in token order; copies of a text
    # under one id give equal (position, token) pairs, which the set merges.
    ex = df.select(F.col(id_col).alias("_id"), _content(F.col(text_col)).alias("_text"),
                   F.posexplode(toks).alias("_i", "_tok"))
    j = ex.join(_unique(slang, slang_col, expansion_col), "_tok", "left")
    words = F.array_sort(F.collect_set(F.struct("_i", F.coalesce("_exp", "_tok").alias("w"))))
    agg = j.groupBy("_id", "_text").agg(
        F.array_join(F.transform(words, lambda s: s["w"]), " ").alias("_x"),
        F.size(F.collect_set(F.when(F.col("_exp").isNotNull(), F.col("_tok")))).alias("_k"))
    met = df.withColumn("_own", _content(F.col(text_col))).join(
        agg, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text")), "left")
    empty = F.when(F.col(text_col).isNotNull(), F.lit(""))
    return met.select(*df.columns, F.coalesce("_x", empty).alias(out_col), F.coalesce("_k", F.lit(0)).alias(count_col))


# ---------------------------------------------------------------- J04
#: A table of up to so many keys becomes one pattern, a larger one an automaton or a join.
PATTERN_MAX_KEYS = 1000


def _is_large(emoji: DataFrame | Mapping[str, str]) -> bool:
    return not isinstance(emoji, Mapping) and emoji.limit(PATTERN_MAX_KEYS + 1).count() > PATTERN_MAX_KEYS


def emoji_rows(emoji: DataFrame | Mapping[str, str], key: str = "emoji", val: str = "meaning") -> list[tuple[str, str]]:
    """The dictionary as ``(emoji, meaning)``, longest key first, for a pattern.
    A table of more than ``PATTERN_MAX_KEYS`` rows is refused: see
    :func:`textlens.operators.phrases.expand_phrases`."""
    rows = emoji.items() if isinstance(emoji, Mapping) else [tuple(r) for r in emoji.select(key, val).limit(PATTERN_MAX_KEYS + 1).collect()]
    if not isinstance(emoji, Mapping) and len(rows) > PATTERN_MAX_KEYS:
        raise ValueError(f"more than {PATTERN_MAX_KEYS} keys: use expand_phrases")
    best: dict[str, str] = {}
    for k, v in rows:
        if k and v is not None:
            best[k] = min(v, best.get(k, v))
    return sorted(best.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def _alternation(rows) -> str:
    # Longest first, each key quoted literally (Java regex).
    return "|".join(r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k, _ in rows)


def _matches(col: Column, rows) -> Column:
    """Dictionary keys found in ``col``, left to right, the longest at each place."""
    return F.regexp_extract_all(col, F.lit(f"({_alternation(rows)})"), 1)


def emoji_replace_expr(col: Column, rows) -> Column:
    """Each match -> `` meaning `` (padding spaces kept, no re-collapse).  The
    text is split on the matches and re-joined with their meanings, so the
    meaning lookup happens per match only."""
    if not rows:
        return col
    meaning = F.create_map(*[F.lit(x) for k, v in rows for x in (k, f" {v} ")])
    pieces = F.split(col, _alternation(rows), -1)
    found = F.transform(_matches(col, rows), lambda m: F.try_element_at(meaning, m))
    joined = F.zip_with(pieces, found, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.when(col.isNotNull(), F.array_join(joined, ""))


def emoji_count_expr(col: Column, rows, count: str = "codepoint") -> Column:
    """Distinct keys among the matches.  ``codepoint`` counts only keys that
    are one code point (longer ones are replaced but never counted);
    ``sequence`` counts every key."""
    if not rows:
        return F.lit(0)
    hits = F.array_distinct(_matches(col, rows))
    if count == "codepoint":
        hits = F.filter(hits, lambda k: F.char_length(k) == 1)
    return F.when(col.isNull(), 0).otherwise(F.size(hits))


def emoji_expand(df: DataFrame, emoji: DataFrame | Mapping[str, str], text_col: str = "text", emoji_col: str = "emoji",
                 meaning_col: str = "meaning", count: str = "codepoint",
                 out_col: str = "expanded", count_col: str = "n_emoji", id_col: str = "doc_id") -> DataFrame:
    """Each known emoji replaced by its meaning between two blanks, the longest
    at each place, and the different ones counted, for dictionaries of any size."""
    if _is_large(emoji):
        return expand_phrases(df, emoji, id_col=id_col, text_col=text_col, key_col=emoji_col, value_col=meaning_col,
                              out_col=out_col, count_col=count_col, single=count == "codepoint")
    rows = emoji_rows(emoji, emoji_col, meaning_col)
    t = F.col(text_col)
    return df.select("*", emoji_replace_expr(t, rows).alias(out_col),
                     emoji_count_expr(t, rows, count).alias(count_col))


# ---------------------------------------------------------------- A10
def preprocess_text(df: DataFrame, slang: DataFrame | Mapping[str, str], emoji: DataFrame | Mapping[str, str],
                    id_col: str = "doc_id", text_col: str = "text", count: str = "codepoint") -> DataFrame:
    """Per row: the slang count and emoji count of the lower-cased stripped
    text, and ``processed_text`` = slang-expanded, then emoji-expanded text.
    One projection (no shuffle) with a small slang mapping."""
    norm = df.select(F.col(id_col), normalized(text_col).alias("_t"))
    expanded = slang_expand(norm, slang, id_col=id_col, text_col="_t", out_col="_x", count_col="n_slang")
    if _is_large(emoji):
        given = {"id_col": id_col, "key_col": "emoji", "value_col": "meaning", "single": count == "codepoint"}
        counted = expand_phrases(expanded, emoji, text_col="_t", out_col="_e", count_col="n_emoji", **given)
        both = expand_phrases(counted, emoji, text_col="_x", out_col="processed_text", count_col="_k", **given)
        return both.select(id_col, "_t", "n_slang", "n_emoji", "processed_text")
    rows = emoji_rows(emoji)
    return expanded.select(
        id_col, "_t", "n_slang",
        emoji_count_expr(F.col("_t"), rows, count).alias("n_emoji"),
        emoji_replace_expr(F.col("_x"), rows).alias("processed_text"),
    )


def knowledge_features(df: DataFrame, lexicon: DataFrame, slang: DataFrame | Mapping[str, str],
                       emoji: DataFrame | Mapping[str, str], id_col: str = "doc_id", text_col: str = "text",
                       count: str = "codepoint") -> DataFrame:
    """``(id, positive, negative, n_slang, n_emoji)``, all from the lower-cased
    stripped text before any replacement; one row per id (per id and text).

    One scan: the two counts are computed per row and ride through the
    token explode as fixed-width columns, so the only aggregate is a hash
    aggregate whose partial step (in the task that exploded the text)
    already reduces the tokens to one row per text.  The processed text is
    deliberately not carried through the explode (that would copy the whole
    text once per token); get it from :func:`preprocess_text`.
    """
    feats = preprocess_text(df, slang, emoji, id_col, text_col, count).drop("processed_text")
    sent = lexicon_sentiment(feats, lexicon, id_col=id_col, text_col="_t", carry=("n_slang", "n_emoji"))
    return sent.select(id_col, "positive", "negative", "n_slang", "n_emoji")


def knowledge_vector(features: DataFrame, out_col: str = "knowledge", size: int = KNOWLEDGE_DIM) -> DataFrame:
    """The four feature slots padded with zeros to ``size`` as an ML vector.

    ``VectorAssembler`` stores the result compressed, i.e. as a sparse vector
    of at most four entries, so the padding costs nothing downstream."""
    slots = ("positive", "negative", "n_slang", "n_emoji")
    tmp = features.select("*", *[F.col(c).cast("double").alias(f"_kv_{c}") for c in slots],
                          array_to_vector(F.array_repeat(F.lit(0.0), size - len(slots))).alias("_kv_pad"))
    out = VectorAssembler(inputCols=[*[f"_kv_{c}" for c in slots], "_kv_pad"], outputCol=out_col).transform(tmp)
    return out.drop(*[f"_kv_{c}" for c in slots], "_kv_pad")
