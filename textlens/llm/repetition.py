"""Quality rules on repetition inside a text, from a suffix array.

The words of a batch of texts are numbered and sorted into one suffix array by
prefix doubling, with the text as the leading key, so suffixes of different
texts never compare equal and only the positions that still tie are sorted
again.  The ranks of every round are kept; descending through them gives the
longest common prefix (LCP) of neighbours in the array.  An LCP interval is a
maximal repeated substring and its positions; the longest repeat that starts
at a word is the larger LCP with its two neighbours, so the union of all
maximal repeats of at least ``min_repeat`` words is the union of
``[p, p + longest(p))`` over words with ``longest(p) >= min_repeat``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CHUNK_WORDS = 400_000


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence that starts there
    and also elsewhere in its text (overlaps count).  ``words``: word numbers
    from 0, ``text``: number of the text, not decreasing."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, side="right")
    first = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # place of the group's start
    rank[n] = -1
    rounds = [rank.copy()]
    twin = ~(new & np.append(new[1:], True))
    active = order[twin]  # in the order of the array so far
    shared = np.sort(active)
    h = 1
    while len(active):
        behind = active + h
        second = np.where(behind < end[active], rank[np.minimum(behind, n)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        group = rank[active]
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        parts = starts | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        group_start = at[starts][np.cumsum(starts) - 1]
        part_start = at[parts][np.cumsum(parts) - 1]
        rank[active] = group + part_start - group_start
        rounds.append(rank.copy())
        alone = parts & np.append(parts[1:], True)
        active = active[~alone]
        h *= 2
    # neighbours in the array among words that occur twice in their text
    array = shared[np.argsort(rank[shared])]
    a, b = array[:-1], array[1:]
    near = rounds[0][a] == rounds[0][b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        same = rounds[k][np.minimum(a + lcp, n)] == rounds[k][np.minimum(b + lcp, n)]
        lcp[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def covered(longest: np.ndarray, at_least: int, length: int | None = None) -> np.ndarray:
    """Whether each word lies in a repeat of at least ``at_least`` words
    (``length``: count only that many words from each start)."""
    start = np.flatnonzero(longest >= at_least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + (longest[start] if length is None else length), -1)
    return np.cumsum(change[:-1]) > 0


def _lines_again(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_WS):
            again += line in seen
            seen.add(line)
    return again


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10,
                     max_covered: float = 0.3, max_longest: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``id_col``; the base statistics ``n_words``,
    ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``
    (lines with a word, equal to an earlier line), ``n_repeat_words`` (words in
    3-word windows found twice or more); ``base_failed`` (under 50 words, or
    over half of them in such windows); ``covered_words`` (in the union of
    repeats of ``min_repeat`` words or more), ``longest_repeat`` (words),
    ``spans`` (that union as word offsets, end excluded) and ``kept``: not
    base_failed, at most ``max_covered`` of the words covered, and no repeat
    longer than ``max_longest`` words.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  A null or empty text
    has none and fails.  Ids, null ones too, pass through; repeated rows stay
    repeated; an empty table gives an empty result; other columns are not
    read.  Texts are taken in chunks of about 400,000 words; a longer one is a
    chunk of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, "
              "longest_repeat long, spans array<struct<start: long, end: long>>")

    def verdicts(texts: list[str], words: list[list[bytes]]) -> list[dict]:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        counts = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        longest = longest_repeats(ids, np.repeat(np.arange(len(words)), counts))
        ends = np.cumsum(counts)
        # repeats end inside their text, so coverage of the chunk is coverage of each text
        windows, long = covered(longest, 3, 3), covered(longest, min_repeat)
        out = []
        for text, n, e in zip(texts, counts.tolist(), ends.tolist()):
            here = slice(e - n, e)
            again, cover = int(windows[here].sum()), int(long[here].sum())
            most = int(longest[here].max(initial=0))
            failed = n < 50 or 100 * again > 50 * n
            edge = np.flatnonzero(np.diff(long[here].astype(np.int8), prepend=0, append=0))
            out.append({"n_words": n, "word_chars": len(text) - sum(map(text.count, _WS)),
                        "n_symbols": sum(map(text.count, _SYMBOLS)), "n_dup_lines": _lines_again(text),
                        "n_repeat_words": again, "base_failed": failed,
                        "kept": not failed and cover <= max_covered * n and most <= max_longest,
                        "covered_words": cover, "longest_repeat": most,
                        "spans": [{"start": s, "end": t} for s, t in edge.reshape(-1, 2).tolist()]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            texts: list[str] = []
            words: list[list[bytes]] = []
            held = 0
            for text in batch.column("text"):
                texts.append(text.as_py() or "")
                # bytes.split() cuts at exactly the six white-space bytes of the word rule
                words.append(texts[-1].encode().split())
                held += len(words[-1])
                if held >= _CHUNK_WORDS:
                    out += verdicts(texts, words)
                    texts, words, held = [], [], 0
            out += verdicts(texts, words)
            made = pa.Table.from_pylist(out, schema=_OUT).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in made.columns]],
                ["id", *made.column_names])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_OUT = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                 + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()),
                    ("longest_repeat", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
