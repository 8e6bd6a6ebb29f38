"""Substring de-duplication by hashing units of text.

Units are hashed (128 bits, of their words, A-Z lower-cased and without
sentence ends); digests are grouped globally, the earliest occurrence by (id,
text, position) is kept and later ones are removed, with their places in the
original text.  There are two kinds:

* :func:`repeated_passages` (the query): units are stretches of ``min_words``
  words or a few more, from one border to another.  Borders hang on the nearby
  words alone, so copies are cut alike whatever stands around them, and a passage
  pasted in mid-sentence is found.  Each unit removed stands word for word at one
  earlier place.
* :func:`repeated_spans`: units are lines, paragraphs, or sentences inside lines,
  which cover the text without gaps.  Such a unit may be short and found
  everywhere, so later ones are removed only in runs of neighbouring units, each
  seen before, with at least ``min_words`` words.  The units of a run may have
  been seen at different places, and what is glued to a passage's edge is kept.

Grouping combines before its shuffle, so a digest found in a third of all
units is one row per task; the join that flags later occurrences splits a hot
digest by adaptive skew handling; rows repeated in id and text are combined in
each task before a document's units are brought together.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import staged

#: Units cover the text without gaps; separators belong to the unit before them.
UNITS = {
    "sentence": r"[^.!?\n]*[.!?\n]+|[^.!?\n]+",
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"[^\n]+(?:\n[^\n]+)*\n*|\n+",
}
# bytes: A-Z lower-cased, sentence ends to spaces
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b".!?" else c for c in range(256))
_KEY = ["id", "text_hash"]
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r.!?"))  # between words
#: Of any so many neighbouring word pairs of a text one is a border: 5.5 words apart on average, 10 at most.
BORDER_WINDOW = 10
_MIX = np.random.default_rng(2).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_CHUNK_BYTES = 1_000_000


def split_units(docs: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, unit, start, end, n_words, h1, h2)``: the units of
    every whole text, counted from 0, with code point offsets."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")
    pattern = re.compile(UNITS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, end, words, h1, h2 = [], [], [], [], [], [], []

            def made() -> pa.RecordBatch:
                at = pa.array(row, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("text_hash").take(at),
                     *[pa.array(x, pa.int32()) for x in (number, start, end, words)],
                     *[pa.array(x, pa.int64()) for x in (h1, h2)]],
                    [*_KEY, "unit", "start", "end", "n_words", "h1", "h2"])

            for r, text in enumerate(batch.column("text")):
                for k, m in enumerate(pattern.finditer(text.as_py())):
                    key = m[0].encode().translate(_NORMAL).split()
                    a, b = struct.unpack("<qq", hashlib.md5(b" ".join(key)).digest())
                    row.append(r)
                    number.append(k)
                    start.append(m.start())
                    end.append(m.end())
                    words.append(len(key))
                    h1.append(a)
                    h2.append(b)
                if len(row) > 200_000:
                    yield made()
                    row, number, start, end, words, h1, h2 = [], [], [], [], [], [], []
            yield made()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, unit int, start int, end int, n_words int, h1 long, h2 long")


def _once(later: DataFrame) -> DataFrame:
    """Rows of one document (id and text), each once however often the document
    stands in the table: every task keeps a document's rows once before they are sent
    to one place, so a row that a third of the table repeats costs one set a task."""
    rest = F.struct(*[c for c in later.columns if c not in _KEY])
    return later.groupBy(*_KEY).agg(F.collect_set(rest).alias("rows")).select(*_KEY, F.inline("rows"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence",
                   min_words: int = 20) -> DataFrame:
    """One row per span to remove: ``id_col``, ``text_hash`` (xxhash64 of the
    text), ``start``, ``end`` (code points of the original text, end
    excluded), ``n_units``, ``n_words`` and ``first_<id_col>``, where the
    span's first unit occurs first.

    Documents are ranked by id, a null id first, then by text hash; rows equal
    in id and text are one document.  A null or empty text has no unit.  Units
    without words count as repeats but add no words.  An empty table gives an
    empty result; other columns are not read.
    """
    units = split_units(docs, unit, id_col, text_col)
    place = F.struct("id", "text_hash", "unit")
    first = (units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("h1", "h2", "first"))
    # written: its measured size decides the join, and a hot digest of the units can be split there
    first = staged(first, "first-occurrences")
    later = units.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    later = _once(later.select(*_KEY, "unit", "start", "end", "n_words", F.col("first.id").alias("first")))
    run = F.col("unit") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("unit"))
    spans = later.withColumn("run", run).groupBy(*_KEY, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"),
        F.sum("n_words").alias("n_words"), F.min(F.struct("unit", "first"))["first"].alias("first"))
    return spans.where(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "text_hash", "start", "end", "n_units", "n_words",
        F.col("first").alias(f"first_{id_col}"))


def cut_passages(texts: list[bytes], min_words: int) -> list[np.ndarray | list[bytes]]:
    """Of all stretches of ``min_words`` words or a few more between two
    borders: number of the text, first and last byte, first and last word
    (ends excluded) and the MD5 of the words.

    A border stands behind the word pair of smallest hash of any
    ``BORDER_WINDOW`` neighbouring pairs, and at both ends of a text.  From
    each border on, a stretch reaches to the first border far enough; the last
    one of a text ends with it.
    """
    buf = b"\n".join(texts) + b"\n"
    low = buf.translate(_NORMAL)
    chars = np.frombuffer(low, np.uint8)
    change = np.flatnonzero(np.diff(_SPACE[chars].astype(np.int8), prepend=1))
    begin, stop = change[::2], change[1::2]  # of every word; the last byte is a space
    n = len(begin)
    if n < min_words:
        return [np.zeros(0, np.int64)] * 5 + [[]]
    text_from = np.cumsum([0, *[len(t) + 1 for t in texts]])
    word_from = np.searchsorted(begin, text_from)
    text = np.repeat(np.arange(len(texts)), np.diff(word_from))
    length = stop - begin
    squeezed = np.concatenate([[0], np.cumsum(length + 1)])  # words parted by one space
    within = np.arange(squeezed[-1]) - np.repeat(squeezed[:-1], length + 1)
    # the byte behind a word counts too, so it is made one and the same
    letters = chars[np.repeat(begin, length + 1) + within].copy()
    letters[squeezed[1:] - 1] = 32
    word = np.add.reduceat(_MIX[letters] * (2 * within + 1).astype(np.uint64), squeezed[:-1])
    pair = word.copy()
    pair[1:] += word[:-1] * np.uint64(0x9E3779B97F4A7C15)
    for shift in (32, 29):
        pair = (pair ^ (pair >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    border = np.zeros(n + 1, bool)
    border[word_from] = True
    w = BORDER_WINDOW
    if n > w:
        at = np.flatnonzero(text[:-w] == text[w:]) + 1  # whose pairs are all of one text
        least = np.lib.stride_tricks.sliding_window_view(pair[::-1], w)[n - w - at].argmin(axis=1)  # the last of equal ones
        border[at + w - least] = True
    place = np.flatnonzero(border)
    # forward from every border but the last, then backward from the end of every text
    a = place[:-1]
    b = np.append(place, n + 1)[np.searchsorted(place, a + min_words)]
    fits = b <= word_from[text[a] + 1]
    a, b = a[fits], b[fits]
    end = word_from[1:][np.diff(word_from) >= min_words]
    back = place[np.searchsorted(place, end - min_words, side="right") - 1]
    new = ~np.isin(end, b) | (np.append(b, 0)[np.searchsorted(a, back)] != end)
    a, b = np.append(a, back[new]), np.append(b, end[new])
    of = text[a]
    # separators belong to the word before, those at the start of the text to its first word
    first = np.where(a == word_from[of], text_from[of], begin[a])
    last = np.where(b == word_from[of + 1], text_from[of + 1] - 1, np.append(begin, 0)[b])
    keys = letters.tobytes()
    digests = [hashlib.md5(keys[s:e]).digest() for s, e in zip(squeezed[a].tolist(), (squeezed[b] - 1).tolist())]
    return [of, first - text_from[of], last - text_from[of], a - word_from[of], b - word_from[of], digests]


def split_passages(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, start, end, word, word_end, h1, h2)``: the stretches
    of :func:`cut_passages` of every whole text, with code point offsets."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")

    def made(batch: pa.RecordBatch, low: int, texts: list[bytes]) -> pa.RecordBatch:
        of, *places, digests = cut_passages(texts, min_words)
        # bytes to code points: without the continuation bytes before
        edges = np.stack(places[:2])
        starts = np.searchsorted(np.sort(of), np.arange(len(texts) + 1))
        order = np.argsort(of, kind="stable")
        for r, t in enumerate(texts):
            if starts[r] < starts[r + 1] and not t.isascii():
                mine = order[starts[r]:starts[r + 1]]
                points = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                edges[:, mine] = points[edges[:, mine]]
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = pa.array(of + low, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("text_hash").take(at),
             *[pa.array(x, pa.int32()) for x in (*edges, *places[2:])],
             *[pa.array(np.ascontiguousarray(x), pa.int64()) for x in (h[:, 0], h[:, 1])]],
            [*_KEY, "start", "end", "word", "word_end", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes] = []
            low = held = 0
            for r, text in enumerate(batch.column("text")):
                texts.append(text.as_py().encode())
                held += len(texts[-1])
                if held >= _CHUNK_BYTES:
                    yield made(batch, low, texts)
                    texts, low, held = [], r + 1, 0
            yield made(batch, low, texts)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, start int, end int, word int, word_end int, h1 long, h2 long")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = 20) -> DataFrame:
    """As :func:`repeated_spans`, wherever a passage begins and ends: every
    word removed lies in a stretch of ``min_words`` words or more that stands
    word for word at an earlier place too.

    With ``b = BORDER_WINDOW``, a repeat of ``min_words + 3 * b - 1`` words or
    more (49 by default) is always found, but for up to ``b + 1`` words at its
    start and ``2 * b - 2`` at its end.  Where a text repeats itself with an
    overlap, the first stretch is kept whole.  ``n_units`` counts stretches.
    """
    units = split_passages(docs, min_words, id_col, text_col)
    place = F.struct("id", "text_hash", "start", "end", "word_end")
    first = (units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("h1", "h2", "first"))
    first = staged(first, "first-passages")
    later = units.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = later.select(*_KEY, F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start")).alias("start"), "end",
                         F.when(own, F.greatest("word", "first.word_end")).otherwise(F.col("word")).alias("word"), "word_end",
                         F.col("first.id").alias("first"))
    later = _once(later.where("word < word_end"))
    order = Window.partitionBy(*_KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    spans = apart.withColumn("run", F.sum("new").over(order)).groupBy(*_KEY, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"),
        (F.max("word_end") - F.min("word")).cast("long").alias("n_words"),
        F.min(F.struct("start", "end", "first"))["first"].alias("first"))
    return spans.where(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "text_hash", "start", "end", "n_units", "n_words",
        F.col("first").alias(f"first_{id_col}"))


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of :func:`repeated_spans` cut out of their
    texts; same columns.  A text without spans is unchanged, a null one too."""
    cuts = spans.groupBy(F.col(id_col).alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_llm_cuts"))
    met = docs.withColumn("_llm_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(
        cuts, F.col(id_col).eqNullSafe(F.col("_llm_id")) & (F.col("_llm_own") == F.col("_llm_hash")), "left")
    text, c = F.col(text_col), F.col("_llm_cuts")
    n = F.array_size(c)

    def between(i):  # what stands before cut i + 1, or behind the last one
        begin = F.when(i == 0, 0).otherwise(F.get(c, i - 1)["end"])
        stop = F.when(i == n, F.char_length(text)).otherwise(F.get(c, i)["start"])
        return F.substring(text, begin + 1, stop - begin)

    cut = F.array_join(F.transform(F.sequence(F.lit(0), n), between), "")
    return met.select(*[F.when(n.isNull(), text).otherwise(cut).alias(x) if x == text_col else F.col(f"`{x}`")
                        for x in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS us FROM documents) t),
k AS (SELECT doc_id, pos, length(u) AS len,
        translate(regexp_extract_all(u, '[^\x20\x09-\x0D.!?]+')::VARCHAR,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
        len(regexp_extract_all(u, '[^\x20\x09-\x0D.!?]+')) AS words,
        coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
f AS (SELECT key, min(doc_id * 1000000 + pos) AS rank FROM k GROUP BY key),
j AS (SELECT k.*, rank // 1000000 AS first_doc, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
      FROM k JOIN f USING (key) WHERE doc_id * 1000000 + pos <> rank)
SELECT doc_id, CAST(min(start) AS INT) AS start, CAST(max(start + len) AS INT) AS "end", count(*) AS n_units,
       CAST(sum(words) AS BIGINT) AS n_words, min_by(first_doc, pos) AS first_doc_id
FROM j GROUP BY doc_id, run HAVING sum(words) >= 20
"""
