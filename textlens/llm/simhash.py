"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
Fingerprints within 3 bits have count vectors within Manhattan distance 3, so
on one of the two 16-segment halves the distance is at most 1.  The grid join
runs per half: its cells are the count vectors of the half (unit width), a
fingerprint lies in one cell and probes that cell and the up to 16 cells one
step above; a pair one step apart is met from its lower side only.  Pairs that
meet are verified on all 64 bits.  Only distinct fingerprints enter, so exact
copies, however many, are one row.

A cell of more than ``hot_cell`` different fingerprints is not paired up.  The
fingerprints that meet there go through a join of Hamming balls instead: for
every z, all fingerprints within 2 bits of z are linked to the smallest one
within 1 bit of z.  That gives the same components from at most 2146 rows per
fingerprint, however full the cell is.

Bounds: 28 rows per distinct fingerprint into the grid join, at most
``hot_cell`` candidates per probe.  Both joins are sort-merge joins by hint:
the planner takes exploded rows for no more than the table they come from, and
would broadcast them through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import staged
from textlens.llm.components import connected_components

_LOWER = {i: i + 32 for i in range(65, 91)}
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The text's 64-bit SimHash (unsigned): A-Z lower-cased, words
    ``[^\\x20\\x09-\\x0D]+``, ``shingle``-word shingles with repeats (fewer
    words: the whole sequence; none: 0), XXH64 with seed 42, a bit set if in
    over half the hashes.  Hashes are counted in chunks, so a very long text
    needs little more memory than itself."""
    # bytes.split() cuts at exactly the six ASCII white-space bytes of the word rule
    words = (text or "").translate(_LOWER).encode().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    end = start + sizes
    end = end[min(shingle, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        spans = zip(start[k:min(k + _CHUNK, n)].tolist(), end[k:k + _CHUNK].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: Sequence[Column] = ()) -> DataFrame:
    """``(id, fp, carry...)``, fp the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"), *carry)


def _grid(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cell, fp, step)`` of every half of every fingerprint: where it lies,
    and where it probes (step 1: one cell up in one segment)."""
    fp = F.col("fp")

    def counts(v: Column) -> Column:  # two bits per segment: 0, 1 or 2
        return v - F.shiftright(v, 1).bitwiseAND(0x55555555)

    halves = F.array(F.struct(F.lit(0).alias("half"), counts(fp.bitwiseAND(0xFFFFFFFF)).alias("v")),
                     F.struct(F.lit(1).alias("half"), counts(F.shiftrightunsigned(fp, 32)).alias("v")))
    at = points.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.v")
    home = at.select(F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("v")).alias("cell"), "fp")
    up = [F.when(F.shiftright("v", 2 * i).bitwiseAND(3) < 2, F.col("v") + (1 << (2 * i))) for i in range(16)]
    probes = F.filter(F.array(F.col("v"), *up), lambda c: c.isNotNull())
    probe = at.select("fp", "half", "v", F.explode(probes).alias("c")).select(
        F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("c")).alias("cell"), "fp",
        (F.col("c") != F.col("v")).alias("up"))
    return home, probe


def _ball_links(points: DataFrame, max_bits: int) -> DataFrame:
    """Links with the same components as all pairs of ``points`` within
    ``max_bits``: inside each ball around z, everyone to the smallest close one."""
    near, far = max_bits // 2, max_bits - max_bits // 2

    def ball(radius: int) -> DataFrame:
        z = points.select("fp", F.col("fp").alias("z"), F.lit(-1).alias("last"))
        out = z
        for _ in range(radius):
            z = z.where("last < 63").select("fp", "z", F.explode(F.sequence(F.col("last") + 1, F.lit(63))).alias("last"))
            z = z.select("fp", F.col("z").bitwiseXOR(F.expr("shiftleft(1L, last)")).alias("z"), "last")
            out = out.union(z)
        return out.select("z", "fp")

    centre = ball(near).groupBy("z").agg(F.min("fp").alias("a"))
    return ball(far).hint("merge").join(centre.hint("merge"), "z").where("fp <> a").select("a", F.col("fp").alias("b"))


def near_links(points: DataFrame, max_bits: int = 3, hot_cell: int = 1024) -> DataFrame:
    """``(a, b)``: links among the distinct fingerprints ``points(fp)``, each
    of at most ``max_bits`` bits; their components are those of all such
    pairs.  Outside hot cells every pair is listed."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two-half grid holds for 0 to 3 bits")
    home, probe = _grid(points)
    hot = home.groupBy("cell").count().where(F.col("count") > hot_cell).select("cell")
    hot = staged(hot, "hot-cells")
    cool = home.join(hot, "cell", "left_anti").withColumnRenamed("fp", "other")
    met = (probe.hint("merge").join(cool.hint("merge"), "cell")
           .where((F.col("up") & (F.col("fp") != F.col("other"))) | (F.col("fp") < F.col("other")))
           .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
           .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    if hot.isEmpty():
        return met
    crowd = home.union(probe.select("cell", "fp")).join(hot, "cell", "left_semi").select("fp").distinct()
    return met.union(_ball_links(staged(crowd, "crowd"), max_bits))


def _components(prints: DataFrame, max_bits: int, hot_cell: int) -> DataFrame:
    """``prints(id, fp, ...)`` with ``component`` and ``component_id``."""
    points = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "points")
    linked = connected_components(near_links(points.select("fp"), max_bits, hot_cell), "a", "b")
    linked = linked.withColumnRenamed("node", "fp")
    smallest = linked.join(points, "fp").groupBy("root").agg(F.min("first").alias("least"))
    groups = points.join(linked.join(smallest, "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    # written, so that a fingerprint of very many copies can be split in the join
    return prints.join(staged(groups, "groups"), "fp")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3, hot_cell: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 lowercase
    hex digits), ``component_id`` (smallest id reachable over links of at most
    ``max_bits`` bits, itself included) and ``component`` (the smallest
    fingerprint reachable, as a signed long: the component's key).

    A null text has fingerprint zero like an empty one, and links like any
    other.  Null ids are never a ``component_id``; a component of null ids
    alone has a null one.  Repeated rows stay repeated.  An empty table gives
    an empty result.  Other input columns are not read.  The (id, fingerprint)
    table, the links and the rounds of the component search are written to the
    shared checkpoint folder.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _components(prints, max_bits, hot_cell).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 3, hot_cell: int = 1024) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of its
    smallest id, and of several such rows the smallest in column order; a
    component of null ids keeps one of them.  Same columns, whatever their
    names.

    Whole rows are combined per (id, text) before their one shuffle, so a row
    repeated over a third of the table costs one row per task."""
    names = [f"_llm_in_{i}" for i in range(len(docs.columns))]
    rid, rtext = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    key = [F.xxhash64(rid, rtext).alias("_llm_k1"), F.crc32(F.coalesce(F.col(rtext), F.lit("")).cast("binary")).alias("_llm_k2")]
    rows = docs.toDF(*names)
    prints = staged(fingerprints(rows, rid, rtext, shingle, key), "fingerprints")
    winners = (_components(prints, max_bits, hot_cell).where(F.col("id").eqNullSafe(F.col("component_id")))
               .groupBy("component").agg(F.min(F.struct("_llm_k1", "_llm_k2")).alias("w")).select("w.*"))
    once = rows.select(*key, F.struct(*names).alias("row")).groupBy("_llm_k1", "_llm_k2").agg(F.min("row").alias("row"))
    kept = once.join(winners, ["_llm_k1", "_llm_k2"], "left_semi").select("row.*")
    return kept.toDF(*docs.columns)
