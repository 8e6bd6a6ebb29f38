"""Dictionary phrases in texts: leftmost-longest matches for dictionaries of any size.

Each text is read from the left; where keys of the dictionary begin, the
longest is a match, and reading goes on behind it.

Two ways give the same result.  Up to ``max_keys`` keys and ``max_bytes`` bytes
of keys and values, which are counted first, the dictionary is shipped to the
tasks as an Aho-Corasick automaton, built once: one pass over a text finds the
matches of a million keys.  Beyond, or without the automaton's library, texts and keys are joined:
every place of a text meets the keys that share its next three
characters, what differs is dropped, and the matches of a text, gathered in
order, are thinned out from the left.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 1_000_000
MAX_BYTES = 64 << 20
_HEAD = 3  # characters by which places and keys are joined


def leftmost_longest(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ``(start, end)`` matches the longest at the first place, then at the first behind it, and so on."""
    longest: dict[int, int] = {}
    for start, end in found:
        longest[start] = max(end, longest.get(start, end))
    out, reach = [], 0
    for start in sorted(longest):
        if start >= reach:
            out.append((start, longest[start]))
            reach = longest[start]
    return out


def _one_value(dictionary: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """Keys listed twice have their smallest value; empty keys and null values are left out."""
    d = dictionary.select(F.col(key_col).alias("_key"), F.col(value_col).alias("_value"))
    return d.where((F.length("_key") > 0) & F.col("_value").isNotNull()).groupBy("_key").agg(F.min("_value").alias("_value"))


def _automaton():
    try:
        import ahocorasick
    except ImportError:  # an optional library: the join needs none
        return None
    return ahocorasick.Automaton


def expand_phrases(df: DataFrame, dictionary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str = "key",
                   value_col: str = "value", out_col: str = "expanded", count_col: str = "n_keys", single: bool = False,
                   max_keys: int = MAX_KEYS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with ``out_col``, each match replaced by its value between two
    blanks, and ``count_col``, the number of different keys matched (with
    ``single`` only those of one code point are counted).  A null text stays
    null and counts 0.  Ids tell texts apart only in the join, together with the text."""
    keys = _one_value(dictionary, key_col, value_col)
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_key") + F.octet_length("_value")).alias("b")).first()
    make = _automaton()
    if make is None or size.n > max_keys or (size.b or 0) > max_bytes:
        return _joined(df, keys, id_col, text_col, out_col, count_col, single)
    automaton = make()
    for k, v in keys.toLocalIterator(prefetchPartitions=True):  # within the counted bounds
        automaton.add_word(k, (len(k), v))
    if size.n:
        automaton.make_automaton()
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(automaton))
    none = not size.n
    names = [f"_in{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    text_at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = pickle.loads(shipped.value)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(text_at).to_pylist():
                if t is None or none:
                    texts.append(t)
                    counts.append(0)
                    continue
                value, met = {}, []
                for last, (n, v) in found_in.iter(t):
                    met.append((last + 1 - n, last + 1))
                    value[last + 1 - n, last + 1] = v
                out, at, seen = [], 0, set()
                for a, b in leftmost_longest(met):
                    out += [t[at:a], " ", value[a, b], " "]
                    at = b
                    if not single or b - a == 1:
                        seen.add(t[a:b])
                texts.append("".join([*out, t[at:]]))
                counts.append(len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                                             [*names, "_expanded", "_n"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema)) + ", _expanded string, _n int"
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)], F.col("_expanded").alias(out_col), F.col("_n").alias(count_col))


def _joined(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, out_col: str, count_col: str, single: bool) -> DataFrame:
    """:func:`expand_phrases` for dictionaries that no task can hold."""
    keys = keys.select("_key", "_value", F.length("_key").alias("_len"), F.substring("_key", 1, _HEAD).alias("_head"))
    longest = keys.agg(F.max("_len")).first()[0] or 0
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = df.where(F.length(text_col) > 0).select(mark.alias("_mark"), F.col(text_col).alias("_text")).distinct()
    place = texts.select("_mark", "_text", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_at"))
    # of a text only what the longest key could cover travels with a place
    place = place.select("_mark", "_at", F.expr(f"substring(_text, _at, {max(1, longest)})").alias("_next"))
    heads = F.array_distinct(F.array(*[F.substring("_next", 1, k) for k in range(1, _HEAD + 1)]))
    met = place.select("*", F.explode(heads).alias("_head")).join(keys, "_head").where(
        F.expr("substring(_next, 1, _len)") == F.col("_key"))
    best = met.groupBy("_mark", "_at").agg(F.max(F.struct("_len", "_key", "_value")).alias("m"))
    all_ = best.groupBy("_mark").agg(F.array_sort(F.collect_list(F.struct("_at", "m._len", "m._key", "m._value"))).alias("_all"))
    # from the left: a match that begins before the last one's end is none
    kind = "array<struct<_at:int,_len:int,_key:string,_value:string>>"
    taken = F.aggregate("_all", F.array().cast(kind), lambda acc, m: F.when(
        (F.size(acc) == 0) | (F.element_at(acc, -1)["_at"] + F.element_at(acc, -1)["_len"] <= m["_at"]),
        F.concat(acc, F.array(m))).otherwise(acc))
    held = all_.select(F.col("_mark").alias("_m"), taken.alias("_taken"))
    whole = df.withColumn("_own", mark).join(held, F.col("_own") == F.col("_m"), "left")
    n = F.size("_taken")

    def piece(i):
        """What stands between match i - 1 and match i, and the value of match i."""
        before = F.when(i == 0, F.lit(1)).otherwise(F.get("_taken", i - 1)["_at"] + F.get("_taken", i - 1)["_len"])
        stop = F.when(i == n, F.length(text_col) + 1).otherwise(F.get("_taken", i)["_at"])
        value = F.when(i == n, F.lit("")).otherwise(F.concat(F.lit(" "), F.get("_taken", i)["_value"], F.lit(" ")))
        return F.concat(F.substring(F.col(text_col), before, stop - before), value)

    made = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    hit = F.transform(F.filter("_taken", lambda m: (m["_len"] == 1) | F.lit(not single)), lambda m: m["_key"])
    return whole.select(*df.columns, F.when(F.col("_taken").isNull(), F.col(text_col)).otherwise(made).alias(out_col),
                        F.coalesce(F.size(F.array_distinct(hit)), F.lit(0)).alias(count_col))
