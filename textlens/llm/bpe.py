"""Byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local rank file (one base64 token and its rank per line),
read once per task.  Long texts are cut at safe boundaries first,
places that end a match of the pre-tokenisation pattern whatever surrounds
them, so the ids of the pieces, one after the other, are the ids of the text:

* after a character that is not white space and before white space: no match
  runs on from a non-space into white space, and what a white-space run
  matches depends on nothing before it;
* before the last character of a white-space run that a non-space follows:
  that character goes with the word behind it, the rest is one match.

A white-space run too long for the pattern engine's stack is merged as the
one match that it is, without the engine.  Decoding concatenates the tokens'
raw bytes, so ids that end inside a character are fine.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode White_Space, the \s of the pattern engine
_SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(f"[{_SPACE}]{{10000,}}")


def encoder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at safe boundaries, each piece ending at the first one at
    or after ``size`` characters (a stretch without any stays whole)."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str | None, size: int = 100_000) -> list[int]:
    """The ids of the whole text; null has none."""
    if not text:
        return []
    if len(text) < 10_000:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        # all of the run is one match at the end of the text, else all but its last character
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in pieces(text[at:run.start()], size):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start():end].encode())
        at = end
    for piece in pieces(text[at:], size):
        ids += enc.encode_ordinary(piece)
    return ids


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes that the ids stand for."""
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids_sha256``
    (of the decimal ids joined by one space), ``decoded_sha256`` (of the bytes
    decoded from the ids) and, if asked, ``ids``.

    Every whole text is encoded, a null one as empty (no ids).  Ids, null ones
    too, are passed through; repeated rows stay repeated; an empty table gives
    an empty result; other columns are not read.  ``rank_file`` must be
    readable at that path on every executor.
    """
    # the id travels beside the text as it is, whatever its type
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            counts, shas, decoded, every = [], [], [], []
            for text in batch.column("text"):
                ids = encode(enc, text.as_py())
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                if with_ids:
                    every.append(pa.array(ids, pa.int32()))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                       pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *_running(counts)], pa.int32())
                flat = pa.concat_arrays(every) if every else pa.array([], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _running(counts: list[int]) -> list[int]:
    total, out = 0, []
    for n in counts:
        total += n
        out.append(total)
    return out
