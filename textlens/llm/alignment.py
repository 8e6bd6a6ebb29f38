"""Alignment of two tokenizers' tokens by pointer jumping.

Every text is encoded by a byte-level BPE (A, of a blank and the text) and by
a piece BPE (B, of the text, whose leading blank it adds itself), so both lists
of tokens spell the same bytes.  Tokens overlap if their byte ranges do.  Every token
points to the overlapping token that ends farthest right, an A token before a B
token that ends in the same place.  Pointers are doubled (each takes its
successor's successor) until none moves: each then stands at the last A token of its
connected component, which labels the component.  The components are the
groups between byte offsets where A and B tokens both end.

No token of either runs over a single blank between two words, so texts are
cut there and each distinct part of a chunk is encoded and aligned once; all
new parts of a batch are doubled together, and no token overlaps another
part's.

How many documents hold a pair of ids linked is counted over the corpus.
Documents are dealt into chunks of a bounded number of bytes and written once,
with their pairs; every chunk counts its documents per pair, and only these
counts, one row per chunk and pair, are shuffled, summed, compared with the
best of their A id (who has at most as many rows as B has ids) and given back to the
chunk.  A pair of all documents is so one row per chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm import bpe
from textlens.llm.common import staged

#: A single blank between characters that are not white space: no token of A or B runs over it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BATCH_BYTES = 1 << 20
_BLOCK = 8000
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.whole_a = Tokenizer.from_file(byte_file)
        self.whole_a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_file)
        entry = {i: t for t, i in self.whole_a.get_vocab().items()}
        # the printable stand-ins of byte-level tokens: printable bytes are themselves, the rest follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.a_bytes = [bytes(stand_in[c] for c in entry[i]) if i in entry and all(c in stand_in for c in entry[i])
                        else entry.get(i, "").encode() for i in range(max(entry) + 1)]
        # the file's merges are in the order of their ids, so ids serve as ranks; seven times as fast as its own library
        special = set(self.whole_a.get_added_tokens_decoder())
        self.a = tiktoken.Encoding("a", pat_str=pattern, special_tokens={},
                                   mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if i not in special})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.decimal = [f"{i}{sep}" for i in range(max(len(self.a_len), len(self.b_len))) for sep in ",|;"]
        # of merged pieces none may run from another character into a blank, else texts must stay whole
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """``text`` cut at blanks that no token runs over.  Each part is
        encoded alike wherever it stands: A sees it behind a blank, B adds one."""
        if not text or not self.cuts:
            return [text] if text else []
        simple = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")
        return text.split(" ") if simple and not _RARE_SPACE.search(text) else _CUT.split(text)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A for a blank and ``text``, of B for ``text``; none if either
        does not spell it byte for byte."""
        whole = (" " + text).encode()
        a, b = bpe.encode(self.a, " " + text), self.b.encode(text, num_threads=1)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 in order, of A and B tokens that end at the given
    increasing byte offsets and together cover the same bytes."""
    n = len(a_end)
    over_a = np.searchsorted(b_end, a_end)  # the B token over an A token's last byte, and the other way round
    over_b = np.searchsorted(a_end, b_end)
    to = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, np.arange(n)), over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    last = np.zeros(n, bool)
    last[to] = True  # terminal tokens are A's
    number = np.cumsum(last) - 1
    return number[to[:n]], number[to[n:]]


def group_texts(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray,
                firsts: np.ndarray, decimal: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for the groups from each of ``firsts`` up to the
    next; ``decimal`` holds each id followed by a comma, a bar and a semicolon."""
    # the places of the tokens when groups follow each other, A's tokens before B's
    a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)
    b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")
    code = np.empty(len(a_ids) + len(b_ids), np.int64)
    code[a_at] = 3 * a_ids + np.append(a_group[1:] != a_group[:-1], True)
    code[b_at] = 3 * b_ids + 2 * np.append(b_group[1:] != b_group[:-1], True)
    starts = np.searchsorted(a_group, firsts) + np.searchsorted(b_group, firsts)
    tokens = [decimal[c] for c in code.tolist()]
    stops = [*starts.tolist()[1:], len(tokens)]
    return ["".join(tokens[s:e])[:-1] for s, e in zip(starts.tolist(), stops, strict=True)]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_BATCH_BYTES``, each text whole."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _BATCH_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _blocks(parts: list[str]) -> list[list[str]]:
    """Parts to encode together, joined by blanks; parts that begin or end with
    white space, where no token ends for sure, alone."""
    blocks: list[list[str]] = []
    held = _BLOCK
    for p in sorted(parts, key=lambda p: p[0].isspace() or p[-1].isspace()):
        if held >= _BLOCK or p[0].isspace() or p[-1].isspace():
            blocks.append([])
            held = 0
        blocks[-1].append(p)
        held += len(p) + 1
    return blocks


class Parts:
    """The distinct parts of a chunk's texts, each encoded and aligned once."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.spelled = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # link of every part
        self.links = np.zeros(0, np.int64)

    def add(self, new: list[str]) -> None:
        """Encode parts, find their groups by pointer jumping, list their links."""
        tok = self.tok
        blocks = _blocks(new)
        found = [tok.encode(" ".join(block)) for block in blocks]
        if any(ids is None and len(block) > 1 for block, ids in zip(blocks, found, strict=True)):
            blocks = [x for block, ids in zip(blocks, found, strict=True) for x in ([block] if ids else [[p] for p in block])]
            found = [tok.encode(" ".join(block)) for block in blocks]
        new = list(chain.from_iterable(blocks))
        n = len(new)
        spelled = np.repeat([ids is not None for ids in found], [len(block) for block in blocks])
        a_ids, b_ids = (np.array(list(chain.from_iterable(ids[k] for ids in found if ids)), np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(tok.a_len[a_ids]), np.cumsum(tok.b_len[b_ids])
        # with its blank
        end = np.cumsum(np.where(spelled, np.fromiter((len(p.encode()) + 1 for p in new), np.int64, n), 0))
        n_a, n_b = (np.diff(np.searchsorted(e, end, side="right"), prepend=0) for e in (a_end, b_end))
        a_group, b_group = components(a_end, b_end)
        # between neighbouring ends of A or B lies exactly one overlap of one token of each
        ends = np.union1d(a_end, b_end)
        links = a_ids[np.searchsorted(a_end, ends)] * len(tok.b_len) + b_ids[np.searchsorted(b_end, ends)]
        n_links = np.bincount(np.searchsorted(end, ends), minlength=n)
        closing = np.append(a_group[1:] != a_group[:-1], True)[:len(a_group)]
        n_groups = np.bincount(np.searchsorted(end, a_end[closing]), minlength=n)
        texts = iter(group_texts(a_ids, b_ids, a_group, b_group, (np.cumsum(n_groups) - n_groups)[spelled], tok.decimal))
        self.number.update((p, len(self.groups) + i) for i, p in enumerate(new))
        self.groups += [next(texts) if ok else "" for ok in spelled]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.spelled = np.concatenate([self.spelled, spelled])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str], with_groups: bool) -> dict[str, list | np.ndarray]:
        """The columns of ``texts``: counts, digests, and every text's distinct
        linked pairs (A id times B's ids plus B id) with their links."""
        n = len(texts)
        cut = [self.tok.parts(t) for t in texts]
        if new := [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.number]:
            self.add(new)
        n_parts = np.array([len(c) for c in cut], np.int64)
        part = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n_parts.sum()))
        doc = np.repeat(np.arange(n), n_parts)
        bad = np.bincount(doc[~self.spelled[part]], minlength=n) > 0  # one part not spelled: no tokens at all
        keep = ~bad[doc]
        part, doc = part[keep], doc[keep]
        total = np.zeros((n, 4), np.int64)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[part], 0)])
        total = running[bounds[1:]] - running[bounds[:-1]]
        names = [self.groups[i] for i in part.tolist()]
        groups = [";".join(names[s:e]) for s, e in pairwise(bounds.tolist())]
        n_links = self.counts[part, 3]
        at = np.arange(int(n_links.sum())) + np.repeat(self.first[part] - (np.cumsum(n_links) - n_links), n_links)
        space = len(self.tok.a_len) * len(self.tok.b_len)
        pairs, times = np.unique(np.repeat(doc, n_links) * space + self.links[at], return_counts=True)
        out: dict[str, list | np.ndarray] = {
            **{c: total[:, k] for k, c in enumerate(_NUMBERS)},
            "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in groups],
            "pairs": pairs % space, "times": times, "n_pairs": np.bincount(pairs // space, minlength=n)}
        return out | ({"groups": groups} if with_groups else {})


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate(keys), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                 with_groups: bool = True, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``, whose texts A splits by ``pattern`` before its
    merges: ``id_col``, ``n_a``, ``n_b`` (tokens),
    ``n_groups``, ``n_links`` (overlapping occurrences of an A and a B token),
    ``n_best`` (links whose pair of ids is linked in as many documents of the
    corpus as any pair with the same A id), ``count_sum`` (these numbers of
    documents, summed over the links), ``groups_sha256`` of ``groups``
    (``a1,a2|b1;a3|b2,b3``: ids of A and of B by group) and, if asked, ``groups``.

    Texts that are null or empty, or that either tokenizer does not spell byte
    for byte (those holding U+2581, say), have no tokens: zeros and empty
    strings.  Special tokens' strings are plain text.  A text is never
    split over chunks, so a very long one is a chunk of its own.  Repeated
    rows are documents of their own, each counted; ids, null ones too, are
    passed through.  An empty table gives an empty result; other columns are
    not read.  Both files must be readable at their paths on every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = _NUMBERS
    texts_out = ["groups_sha256", *(["groups"] if with_groups else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(byte_file, piece_file, pattern)
        parts = Parts(tok)
        # of a task that is run again only one attempt's rows are kept, so its chunks are numbered by its partition
        chunk = TaskContext.get().partitionId() << 32
        held, keys, counts = 0, [], []
        id_type = pa.null()

        def summary() -> pa.RecordBatch:
            pair, n = _merged(keys, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64()) for _ in numbers],
                 *[pa.nulls(1, pa.string()) for _ in texts_out], pa.array([pair], pa.list_(pa.int64())),
                 pa.array([n], pa.list_(pa.int64())), pa.array([True])],
                ["chunk", "id", *numbers, *texts_out, "pairs", "times", "summary"])

        for batch in batches:
            id_type = batch.column("id").type
            texts = batch.column("text").to_pylist()
            for lo, hi in _batches(texts):
                got = parts.align(texts[lo:hi], with_groups)
                offsets = pa.array(np.concatenate([[0], np.cumsum(got["n_pairs"])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, chunk)), batch.column("id").slice(lo, hi - lo),
                     *[pa.array(got[c], pa.int64()) for c in numbers], *[pa.array(got[c], pa.string()) for c in texts_out],
                     pa.ListArray.from_arrays(offsets, pa.array(got["pairs"])),
                     pa.ListArray.from_arrays(offsets, pa.array(got["times"], pa.int64())), pa.array(np.zeros(hi - lo, bool))],
                    ["chunk", "id", *numbers, *texts_out, "pairs", "times", "summary"])
                pair, n = np.unique(got["pairs"], return_counts=True)
                keys.append(pair)
                counts.append(n)
                held += sum(map(len, texts[lo:hi]))
                if held >= chunk_bytes:
                    yield summary()
                    chunk, held, keys, counts, parts = chunk + 1, 0, [], [], Parts(tok)
                elif len(keys) >= 16:
                    keys, counts = [[x] for x in _merged(keys, counts)]
        if keys:
            yield summary()

    schema = (f"chunk long, id {kind}, " + "".join(f"{c} long, " for c in numbers)
              + "".join(f"{c} string, " for c in texts_out) + "pairs array<long>, times array<long>, summary boolean")
    held = staged(rows.mapInArrow(encode, schema), "aligned")
    per_chunk = held.where("summary").select(F.col("chunk").alias("of"), F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "of", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = per_chunk.groupBy("pair").agg(F.sum("n").alias("n"))
    space = _piece_count(piece_file)
    top = F.max("n").over(Window.partitionBy(F.expr(f"pair div {space}")))  # at most as many rows as B has ids
    counts = staged(counts.select("pair", "n", (F.col("n") == top).alias("best")), "pair-counts")
    looked_up = per_chunk.select("of", "pair").join(counts, "pair")
    documents = held.where("not summary").drop("summary")
    result = [id_col, *numbers, "n_best", "count_sum", *texts_out]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        pair, n, best = (right.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        sums: dict[str, list[np.ndarray]] = {"n_best": [], "count_sum": []}
        for batch in left.to_batches():
            times = batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, batch.column("pairs").flatten().to_numpy())
            bounds = np.concatenate([[0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())])
            for name, value in (("n_best", times * best[at]), ("count_sum", times * n[at])):
                total = np.concatenate([[0], np.cumsum(value)])
                sums[name].append(total[bounds[1:]] - total[bounds[:-1]])
        added = {c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in sums.items()}
        columns = [left.column("id"), *[left.column(c) for c in numbers], added["n_best"], added["count_sum"],
                   *[left.column(c) for c in texts_out]]
        return pa.Table.from_arrays(columns, ["id", *result[1:]])

    out = documents.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(
        look_up, f"id {kind}, " + "".join(f"{c} long, " for c in result[1:7]) + ", ".join(f"{c} string" for c in texts_out))
    return out.withColumnRenamed("id", id_col)


def _piece_count(piece_file: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_file).get_piece_size()
