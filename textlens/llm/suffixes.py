"""Removal of repeated byte strings by suffix arrays over shards.

A string of ``window`` bytes is removed where it also starts in a document of
a smaller id.  Shards are cut by content, so that equal strings meet in one:

1. Documents are written in chunks of a bounded size, bucketed by chunk, which
   later passes read without moving a text.  Windows (the strings at all
   places of a text) are cut into segments: neighbouring windows that share
   the smallest hash of the grams inside them, their key.
2. Every chunk lists its keys once each; the lists are dealt by key, and a key
   comes back marked where several documents have it.
3. Every chunk sends the distinct segments of marked keys to shards, dealt by
   key, with the least and the greatest id holding each.
4. A shard joins its segments, in batches of whole keys, to one text, whose
   suffix array is built by induced sorting (:mod:`textlens.llm.induced`).
   Where permuted common prefixes reach the window, neighbours in the array
   start with the same string; the least id of such a run is given back to the chunks
   that hold it under a greater one.
5. Every chunk marks the bytes to remove.

Skew: a chunk sends one entry per key and one per distinct segment, however
many copies it holds.  Keys with more occurrences than ``hot_key`` (a short
line in a third of all texts, between ever different neighbours) are not kept
together: their windows are segments of their own, dealt by their whole
content, so any number of them is spread and each distinct one is one entry per chunk.
Memory per task: a chunk, a list of keys of about 4 million entries, or a
shard's segments with the suffix array of one batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import staged
from textlens.llm.induced import common_prefixes, suffix_array
from textlens.session import scratch_dir

_BLOCK = 1 << 16  # windows hashed at a time
_LONGEST = 256  # windows of a segment
_BASE = 0x9E3779B97F4A7C15
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_LOW = (1 << 40) - 1  # bits of a key in the lists; the others deal it
#: A null id stands before all others.
_NULL_ID = -(1 << 63)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def window_keys(data: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash inside every window of ``data`` (bytes)."""
    up, down = _powers(_BLOCK + window)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIX[data] * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


@dataclass
class Chunk:
    """The texts of one chunk, joined, and the segments of their windows:
    first window, number of windows, key and document of each."""

    data: np.ndarray
    starts: np.ndarray  # of the documents, and the end
    ids: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    doc: np.ndarray

    def by_key(self) -> tuple[np.ndarray, np.ndarray]:
        """Segments ordered by the part of the lists and key, and where keys begin."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def chunk_of(table: pa.Table, window: int, gram: int) -> Chunk:
    table = table.sort_by("row")
    texts = [t.as_py() for t in table.column("text")]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = table.column("id").to_numpy()
    begin, key = [], []
    for s in range(0, len(data) - window + 1, _BLOCK):
        k = window_keys(data[s:s + _BLOCK + window - 1], window, gram)
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        begin.append(new + s)
        key.append(k[new])
    at = np.concatenate(begin) if begin else np.zeros(0, np.int64)
    keys = np.concatenate(key) if key else np.zeros(0, np.uint64)
    # a text's windows are its own: segments also begin with it, and end with its last window
    own = starts[:-1][np.diff(starts) >= window]
    all_at = np.union1d(at, own)
    keys = keys[np.searchsorted(at, all_at, side="right") - 1] if len(at) else keys
    doc = np.searchsorted(starts, all_at, side="right") - 1
    stop = np.minimum(np.append(all_at[1:], len(data)), starts[doc + 1] - window + 1)
    fine = all_at < stop
    all_at, keys, doc, n = all_at[fine], keys[fine], doc[fine], (stop - all_at)[fine]
    # very long ones (periodic texts) in pieces
    pieces = -(-n // _LONGEST)
    if len(n) and pieces.max() > 1:
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        all_at, keys, doc, n = (np.repeat(x, pieces) for x in (all_at, keys, doc, n))
        all_at, n = all_at + nth * _LONGEST, np.minimum(n - nth * _LONGEST, _LONGEST)
    return Chunk(data, starts, ids, all_at, n, keys, doc)


def _least_greatest(ids: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)


def key_lists(chunk: Chunk, number: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """``(part, chunk, list)``: the distinct keys, five bytes each, and behind
    them a byte for how often: the power of two, plus 128 with several ids."""
    order, heads = chunk.by_key()
    if not len(order):
        return
    low, high = _least_greatest(chunk.ids[chunk.doc[order]], heads)
    count = np.diff(heads, append=len(order))
    code = np.ceil(np.log2(count)).astype(np.uint8) | np.where(low < high, 128, 0).astype(np.uint8)
    key = chunk.key[order][heads]
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    by_part = np.argsort(part, kind="stable")
    for these in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        five = (key[these] & np.uint64(_LOW)).view(np.uint8).reshape(-1, 8)[:, :5]
        yield int(part[these[0]]), number, five.tobytes() + code[these].tobytes()


def marks(lists: list[bytes], hot_key: int) -> list[bytes]:
    """For each list of a part a byte per key: 0 if one document alone has it,
    1 if several may, 2 if it is hot as well."""
    sizes = [len(x) // 6 for x in lists]
    eight = np.zeros((sum(sizes), 8), np.uint8)
    eight[:, :5] = np.concatenate([np.frombuffer(x, np.uint8, 5 * n).reshape(-1, 5) for x, n in zip(lists, sizes, strict=True)])
    code = np.concatenate([np.frombuffer(x, np.uint8, n, 5 * n) for x, n in zip(lists, sizes, strict=True)])
    _, which, times = np.unique(eight.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    several = (np.bincount(which, code >= 128) > 0) | (times > 1)
    often = np.bincount(which, np.exp2(code & 127)) > hot_key
    return [x.tobytes() for x in np.split((several * (1 + often)).astype(np.uint8)[which], np.cumsum(sizes)[:-1])]


def sent_segments(chunk: Chunk, marked: dict[int, bytes], parts: int, window: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """The distinct segments of marked keys: their bytes, their keys, and for
    every occurrence its segment and its first window.  Windows of hot keys are
    segments, with keys of their own."""
    order, heads = chunk.by_key()
    if not len(order) or not marked:
        return [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = chunk.key[order][heads]
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    state = np.zeros(len(key), np.uint8)
    for p, got in marked.items():
        state[part == p] = np.frombuffer(got, np.uint8)
    of = np.zeros(len(order), np.uint8)
    of[order] = np.repeat(state, np.diff(heads, append=len(order)))
    whole = chunk.data.tobytes()
    number: dict[bytes, int] = {}
    keys: list[int] = []
    which: list[int] = []
    first: list[int] = []
    some = np.flatnonzero(of)
    for at, n, k, hot in zip(chunk.at[some].tolist(), chunk.windows[some].tolist(), chunk.key[some].tolist(), (of[some] == 2).tolist(), strict=True):
        for a, m in [(at + i, 1) for i in range(n)] if hot else [(at, n)]:
            segment = whole[a:a + m + window - 1]
            i = number.setdefault(segment, len(number))
            if i == len(keys):
                keys.append(zlib.crc32(segment) | 1 << 63 if hot else k & ~(1 << 63))
            which.append(i)
            first.append(a)
    return list(number), keys, np.array(which, np.int64), np.array(first, np.int64)


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    plain = head + b"".join(raw)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(value: bytes) -> list[bytes]:
    plain = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(plain[:8], "little")
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(plain, np.int64, n, 8)]).tolist()
    return [plain[a:b] for a, b in zip(ends, ends[1:])]


def shipments(chunk: Chunk, marked: dict[int, bytes], parts: int, shards: int, window: int) -> Iterator[tuple[int, bytes]]:
    """``(shard, segments)``: numbers, keys, least and greatest ids, lengths and bytes."""
    segments, keys, which, first = sent_segments(chunk, marked, parts, window)
    if not segments:
        return
    doc = np.searchsorted(chunk.starts, first, side="right") - 1
    by = np.argsort(which, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(which[by]) > 0))
    low, high = _least_greatest(chunk.ids[doc[by]], heads)
    key = np.array(keys, np.uint64)
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    for these in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        mine = [segments[i] for i in these.tolist()]
        yield int(shard[these[0]]), _packed(these.astype(np.int32), key[these], low[these], high[these],
                                            np.array([len(x) for x in mine], np.int32), b"".join(mine))


def least_ids(segments: list[bytes], ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct segments, each with the least id holding it: ``(segment,
    window, least id)`` of all their windows, in order, where the least id is
    that of all windows with the same bytes, found in a suffix array."""
    size = np.array([len(x) for x in segments], np.int64)
    text = np.zeros(int(size.sum()) + len(segments) + 1, np.uint16)
    starts = np.cumsum(size + 1) - size - 1
    # bytes from 2 on; 1 parts the segments, 0 ends the text
    text[:-1] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:-1] += 2
    text[starts + size] = 1
    array = suffix_array(text)
    windows = size - window + 1
    common = common_prefixes(text, array, starts, starts + windows, window)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), windows)
    place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(text), -1, np.int32)
    number[np.repeat(starts, windows) + place] = np.arange(len(place))
    # windows in the order of the array; equal ones are neighbours there
    sorted_ = array[number[array] >= 0]
    heads = np.flatnonzero(common[sorted_] < window)
    in_order = number[sorted_]
    least = np.minimum.reduceat(ids[segment[in_order]], heads)
    out = np.empty(len(place), np.int64)
    out[in_order] = np.repeat(least, np.diff(heads, append=len(in_order)))
    return segment, place, out


def found_windows(received: list[tuple[int, bytes]], window: int, batch_bytes: int) -> Iterator[tuple[int, bytes]]:
    """``(chunk, runs)`` from a shard's ``(chunk, segments)``: the numbers of
    the chunk's segments, first window and number of windows of each run that
    has a smaller id elsewhere than the chunk's greatest, and that id."""
    number: dict[bytes, int] = {}
    keys: list[int] = []
    entries = []
    for chunk, value in received:
        raw = _unpacked(value)
        mine, key, low, high, size = (np.frombuffer(x, t) for x, t in zip(raw, (np.int32, np.uint64, np.int64, np.int64, np.int32), strict=False))
        ends = np.cumsum(size).tolist()
        which = []
        for a, b, k in zip([0, *ends], ends, key.tolist(), strict=False):
            i = number.setdefault(raw[5][a:b], len(number))
            if i == len(keys):
                keys.append(k)
            which.append(i)
        entries.append((np.full(len(mine), chunk), mine, low, high, np.array(which, np.int64)))
    chunk, mine, low, high, which = (np.concatenate(x) for x in zip(*entries, strict=True))
    segments = list(number)
    ids = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(ids, which, low)
    # batches of whole keys
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    key = np.array(keys, np.uint64)[order]
    size = np.array([len(x) + 1 for x in segments], np.int64)[order]
    head = np.append(True, key[1:] != key[:-1])
    group_at = (np.cumsum(size) - size)[head]
    batch = (group_at // batch_bytes)[np.cumsum(head) - 1]
    runs: list[tuple[np.ndarray, ...]] = []
    for these in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
        segment, place, least = least_ids([segments[i] for i in these.tolist()], ids[these], window)
        new = np.append(True, (segment[1:] != segment[:-1]) | (least[1:] != least[:-1]))
        begin = np.flatnonzero(new)
        runs.append((these[segment[begin]], place[begin], np.diff(begin, append=len(segment)), least[begin]))
    of, place, n, least = (np.concatenate(x) for x in zip(*runs, strict=True))
    by = np.argsort(of, kind="stable")
    of, place, n, least = of[by], place[by], n[by], least[by]
    low_run, high_run = np.searchsorted(of, which), np.searchsorted(of, which, side="right")
    times = high_run - low_run
    entry = np.repeat(np.arange(len(which)), times)
    run = np.repeat(low_run, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    tells = least[run] < high[entry]
    entry, run = entry[tells], run[tells]
    for c in np.unique(chunk[entry]).tolist():
        e, r = entry[chunk[entry] == c], run[chunk[entry] == c]
        yield c, _packed(mine[e], place[r].astype(np.int32), n[r].astype(np.int32), least[r])


def removed_bytes(chunk: Chunk, marked: dict[int, bytes], found: list[bytes], parts: int, window: int) -> np.ndarray:
    """Whether each byte of the chunk is removed."""
    _, _, which, first = sent_segments(chunk, marked, parts, window)
    change = np.zeros(len(chunk.data) + 1, np.int32)
    by = np.argsort(which, kind="stable")
    sorted_which = which[by]
    for value in found:
        segment, place, n, least = (np.frombuffer(x, t) for x, t in zip(_unpacked(value), (np.int32, np.int32, np.int32, np.int64), strict=True))
        low, high = np.searchsorted(sorted_which, segment), np.searchsorted(sorted_which, segment, side="right")
        times = high - low
        run = np.repeat(np.arange(len(segment)), times)
        hit = by[np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
        doc = np.searchsorted(chunk.starts, first[hit], side="right") - 1
        smaller = least[run] < chunk.ids[doc]
        begin = (first[hit] + place[run])[smaller]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + n[run][smaller] + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20,
                   with_text: bool = True, chunk_bytes: int = 8 << 20, part_bytes: int = 64 << 20,
                   shard_bytes: int = 16 << 20, batch_bytes: int = 4 << 20, hot_key: int = 1 << 16) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_bytes`` of the text in
    UTF-8, ``n_removed`` bytes, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` of the bytes that remain and, if asked, ``spans`` (start
    and end of each, in bytes) and ``kept`` (those bytes; a removed run may
    begin or end inside a character).

    Strings are judged on the input: what is removed from one text still
    removes from another.  Rows with equal ids are one document in this, so
    they never remove from each other; a null id, which counts as smaller than
    all others, is one as well.  Ids are integers.  Null and empty texts have
    no bytes; texts shorter than ``window`` lose none.  A text of any length is
    one chunk's.  An empty table gives an empty result; other columns are not
    read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.col("id").isNull().alias("no_id"), "text")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a task that is run again only one attempt's rows are kept
        chunk, held, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            of, nth = [], []
            for n in batch.column("text").cast(pa.large_binary()).to_pylist():
                if held and held + len(n) > chunk_bytes:
                    chunk, held, row = chunk + 1, 0, 0
                of.append(chunk)
                nth.append(row)
                held, row = held + len(n), row + 1
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(nth, pa.int32()), *batch.columns],
                                             ["chunk", "row", *batch.schema.names])

    path = scratch_dir(spark, "suffix-chunks")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    (rows.mapInArrow(numbered, "chunk long, row int, id long, no_id boolean, text binary").write.bucketBy(buckets, "chunk")
     .option("path", path).option("compression", "zstd").saveAsTable(name))
    # read by chunk without an exchange, as often as needed
    held = spark.table(name)
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, shards = max(buckets, -(-total // part_bytes)), max(buckets, -(-total // shard_bytes))

    def listed(table: pa.Table) -> pa.Table:
        found = list(key_lists(chunk_of(table, window, gram), table.column("chunk")[0].as_py(), parts))
        return pa.Table.from_pylist([{"part": p, "of": c, "value": v} for p, c, v in found], pa.schema(
            [("part", pa.int64()), ("of", pa.int64()), ("value", pa.binary())]))

    def marked(table: pa.Table) -> pa.Table:
        got = marks(table.column("value").to_pylist(), hot_key)
        back = pa.table({"part": table.column("part"), "of": table.column("of"), "value": pa.array(got, pa.binary())})
        return back.filter(pa.array([any(x) for x in got], pa.bool_()))

    three = "part long, of long, value binary"
    lists = held.groupBy("chunk").applyInArrow(listed, three)
    known = staged(lists.groupBy("part").applyInArrow(marked, three), "suffix-keys")

    def sent(texts: pa.Table, states: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and states.num_rows:
            by_part = dict(zip(states.column("part").to_pylist(), states.column("value").to_pylist(), strict=True))
            of = texts.column("chunk")[0].as_py()
            out = [{"part": s, "of": of, "value": v}
                   for s, v in shipments(chunk_of(texts, window, gram), by_part, parts, shards, window)]
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("of", pa.int64()), ("value", pa.binary())]))

    def sorted_(table: pa.Table) -> pa.Table:
        received = list(zip(table.column("of").to_pylist(), table.column("value").to_pylist(), strict=True))
        out = [{"part": -1, "of": c, "value": v} for c, v in found_windows(received, window, batch_bytes)]
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("of", pa.int64()), ("value", pa.binary())]))

    shipped = held.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(sent, three)
    told = shipped.groupBy("part").applyInArrow(sorted_, three).union(known)

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        texts = texts.sort_by("row")
        chunk = chunk_of(texts, window, gram)
        known_parts: dict[int, bytes] = {}
        found = []
        for p, v in zip(told.column("part").to_pylist(), told.column("value").to_pylist(), strict=True):
            if p < 0:
                found.append(v)
            else:
                known_parts[p] = v
        gone = removed_bytes(chunk, known_parts, found, parts, window) if found else np.zeros(len(chunk.data), bool)
        out: dict[str, list] = {c: [] for c in schema.names}
        for i, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.starts.tolist()[1:])):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(mine, prepend=False, append=False))
            kept = chunk.data[a:b][~mine].tobytes()
            row = {"id": None if texts.column("no_id")[i].as_py() else int(chunk.ids[i]), "n_bytes": b - a, "n_removed": int(mine.sum()),
                   "n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            if with_text:
                row |= {"spans": [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], "kept": kept}
            for c, v in row.items():
                out[c].append(v)
        return pa.Table.from_pydict(out, schema)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("spans", pa.list_(span)), ("kept", pa.binary())] if with_text else []))
    columns = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    columns += ", spans array<struct<start: long, end: long>>, kept binary" if with_text else ""
    out = held.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(cut, columns)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
