"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, the
source's target words over its words.  Documents of a source stand in one
line, ordered by size; the expected copies are prefix-summed along it, one
random offset per source is added, and a document is emitted once per integer
boundary that its step crosses.  Ordering by size keeps the words taken next
to the target, because neighbours in the line have nearly equal sizes.

The line is never sorted in one task.  It is cut into cells (source, number of
digits of the size, its two leading digits, one hex digit of the id's md5);
cell counts are summed into offsets, and only rows inside a cell are ranked.
A source holding a third of all rows is spread over thousands of cells.  A cell
of more than ``cell_rows`` rows (texts of one size, say) is cut on, by size and by
as many more hex digits as its count asks for.  Inside a cell the order is size,
md5, id, so the line is the same however it is cut.
Copies are counted in units of 2**-28, in integers, so no rounding error can
emit a copy too many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import staged, word_count

_BITS = 28
_UNIT = 1 << _BITS
_CELL = ["_llm_src", "_llm_digits", "_llm_lead", "_llm_hex"]
_FINE = ["_llm_part_size", "_llm_part_hex"]


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """``(_llm_src, source_size, target)`` from one row ``(_llm_src, source_size)``
    per source: weights are dealt in order of the source, repeating; targets
    share the total by weight and stop at ``max_repeat`` times the source's
    size, the excess shared again by weight until none is above.

    The fixed point is min(cap, level * weight); the level is found by taking
    sources in order of cap/weight.  One row per source: the two windows here
    hold as many rows as there are sources, never documents.
    """
    by_name, by_ratio = Window.orderBy("_llm_src"), Window.orderBy("_llm_ratio", "_llm_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), rank % len(weights) + 1)
    s = sizes.select("_llm_src", "source_size", weight.alias("_llm_w"),
                     (F.col("source_size") * max_repeat).alias("_llm_cap"))
    s = s.withColumn("_llm_ratio", F.col("_llm_cap") / F.col("_llm_w"))
    everything = Window.partitionBy()
    s = s.select("*",
                 (F.sum("source_size").over(everything)
                  - F.coalesce(F.sum("_llm_cap").over(before), F.lit(0))).alias("_llm_left"),
                 (F.sum("_llm_w").over(everything)
                  - F.coalesce(F.sum("_llm_w").over(before), F.lit(0))).alias("_llm_wleft"),
                 F.row_number().over(by_ratio).alias("_llm_k"))
    fits = F.col("_llm_left") * F.col("_llm_w") <= F.col("_llm_cap") * F.col("_llm_wleft")
    level = F.min(F.when(fits, F.struct("_llm_k", "_llm_left", "_llm_wleft"))).over(everything)
    s = s.withColumn("_llm_level", level)
    capped = (F.col("_llm_cap") * F.col("_llm_level._llm_wleft")
              <= F.col("_llm_level._llm_left") * F.col("_llm_w"))
    share = F.col("_llm_level._llm_left") * F.col("_llm_w") / F.col("_llm_level._llm_wleft")
    return s.select("_llm_src", "source_size",
                    F.when(capped, F.col("_llm_cap").cast("double")).otherwise(share).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[Column], tie: Column) -> DataFrame:
    size = word_count(F.col(text_col))
    digits = size.cast("string")
    return docs.select(
        *carry, F.col(id_col).alias("_llm_id"), size.alias("_llm_size"), tie.alias("_llm_tie"),
        # null sorts behind every source, itself a source
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("_llm_src"),
        F.length(digits).alias("_llm_digits"), F.substring(digits, 1, 2).alias("_llm_lead"),
        F.substring(_md5(F.col(id_col)), 1, 1).alias("_llm_hex"), _md5(F.col(id_col)).alias("_llm_md5"))


def _md5(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _cut_on(coarse: DataFrame, keyed: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``coarse`` (one row per cell, ``_llm_n`` rows in each) with the number
    ``_llm_more`` of further hex digits, 0 for cells of up to ``cell_rows``; and,
    where there are larger ones, the rows before each of their parts inside the
    cell (``_llm_inner``), by size and digits."""
    more = F.ceil(F.log(F.col("_llm_n") / cell_rows) / F.log(F.lit(16.0))).cast("int")
    coarse = coarse.withColumn("_llm_more", F.when(F.col("_llm_n") > cell_rows, F.least(F.greatest(more, F.lit(1)), F.lit(31))).otherwise(0))
    large = coarse.where("_llm_more > 0").select(*_CELL, "_llm_more")
    if large.isEmpty():
        return coarse, None
    parts = keyed.join(large, _CELL).groupBy(*_CELL, *_fine()).agg(F.count(F.lit(1)).alias("_llm_n"))
    line = Window.partitionBy(*_CELL).orderBy(*_FINE).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select(*_CELL, *_FINE, F.coalesce(F.sum("_llm_n").over(line), F.lit(0)).alias("_llm_inner"))
    return coarse, staged(inner, "mix-parts")


def _fine() -> list[Column]:
    """The part of a cell that a row falls into: size and further digits, or nothing."""
    cut = F.col("_llm_more") > 0
    return [F.when(cut, F.col("_llm_size")).otherwise(0).alias(_FINE[0]),
            F.when(cut, F.expr("substring(_llm_md5, 2, _llm_more)")).otherwise("").alias(_FINE[1])]


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix",
             carry: Sequence[str] = (), cell_rows: int = 1 << 17) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns, ``id_col``, ``size``
    (words), ``source_size``, ``target`` (of its source), ``taken`` (copies x
    size) and ``copies``.  Same input and seed, same result, whatever the
    partitioning.

    A null text has size 0; a null source is a source of its own, last in
    order; a null id ranks before other ids.  Rows with equal id and size are
    told apart by a hash of the carried columns, else interchangeable.  A
    source without words has target 0 and takes no copies.  An empty table
    gives an empty result.  A carried column with the name of an output
    column is left out.  A very long text counts as any other.  Cells are counted in a first job and kept as a small
    table in the shared checkpoint folder.
    """
    out = [id_col, "size", "source_size", "target", "taken", "copies"]
    kept = [c for c in carry if c.lower() not in {n.lower() for n in out}]
    held = [f"_llm_in_{i}" for i in range(len(kept))]  # under names that clash with nothing here
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in (kept or [text_col])])
    keyed = _keyed(docs, id_col, text_col, source_col, [], F.lit(0))
    cells = staged(keyed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_llm_n"), F.sum("_llm_size").alias("_llm_words")),
                   "mix-cells")
    sources = source_targets(
        cells.groupBy("_llm_src").agg(F.sum("_llm_words").alias("source_size")), weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * _UNIT)).otherwise(0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_llm_src")).cast("binary")), 1, 7), 16, 10)
    sources = sources.select("*", rate.cast("long").alias("_llm_rate"), start.cast("long").alias("_llm_start"))
    line = Window.partitionBy("_llm_src").orderBy(*_CELL[1:]).rowsBetween(Window.unboundedPreceding, -1)
    cells, inner = _cut_on(cells, keyed, cell_rows)
    offsets = cells.select(*_CELL, "_llm_more", F.coalesce(F.sum("_llm_n").over(line), F.lit(0)).alias("_llm_before"))
    offsets = offsets.join(sources, "_llm_src")

    inputs = [F.col(f"`{c}`").alias(h) for c, h in zip(kept, held)]
    rows = _keyed(docs, id_col, text_col, source_col, inputs, tie).join(offsets, _CELL)
    if inner is None:
        rows, group = rows.withColumn("_llm_inner", F.lit(0).cast("long")), _CELL
    else:
        group = [*_CELL, *_FINE]
        rows = rows.select("*", *_fine()).join(inner, group, "left").withColumn("_llm_inner", F.coalesce("_llm_inner", F.lit(0)))
    inside = Window.partitionBy(*group).orderBy("_llm_size", "_llm_md5", "_llm_id", "_llm_tie")
    place = F.col("_llm_before") + F.col("_llm_inner") + F.row_number().over(inside) - 1
    part = F.col("_llm_rate").bitwiseAND(_UNIT - 1)
    # fractional part of offset + prefix sum before this document, in units
    phase = (F.col("_llm_start") + place.bitwiseAND(_UNIT - 1) * part).bitwiseAND(_UNIT - 1)
    copies = F.shiftright("_llm_rate", _BITS) + F.when(phase + part >= _UNIT, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).select(
        *[F.col(h).alias(c) for c, h in zip(kept, held)], F.col("_llm_id").alias(id_col), F.col("_llm_size").alias("size"),
        "source_size", "target", (F.col("copies") * F.col("_llm_size")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (rows taken
    0 times are gone); same columns.  Options, and what nulls, ties, repeated
    rows and very long texts give, as in :func:`plan_mix`: repeated rows are
    each taken by themselves, a null text has no words and is taken as its source's rate says.  An empty
    table gives an empty result; columns of any name pass through."""
    renamed = [f"_llm_row_{i}" for i in range(len(docs.columns))]
    names = {k: options.pop(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    inner = {k: renamed[docs.columns.index(v)] for k, v in names.items()}
    plan = plan_mix(docs.toDF(*renamed), carry=renamed, **inner, **options)
    repeats = plan.where("copies > 0").withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeats.select(*[F.col(r).alias(c) for r, c in zip(renamed, docs.columns)])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce('s' || source, 't') AS src FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM d GROUP BY src),
s1 AS (SELECT *, 3 * n AS cap, row_number() OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, src) AS k,
         sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, src
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_n,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, src
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM s0),
lv AS (SELECT left_n AS ln, left_w AS lw FROM s1 WHERE left_n * w <= cap * left_w ORDER BY k LIMIT 1),
s AS (SELECT src, n, CASE WHEN cap * lw <= ln * w THEN CAST(cap AS DOUBLE)
         ELSE CAST(ln * w AS DOUBLE) / CAST(lw AS DOUBLE) END AS target FROM s1, lv),
q AS (SELECT d.*, n, target,
         CAST(CASE WHEN n > 0 THEN round(target / n * 268435456) ELSE 0 END AS BIGINT) AS rate,
         CAST('0x' || substr(md5('mix:' || src), 1, 7) AS BIGINT) AS start,
         row_number() OVER (PARTITION BY src ORDER BY length(CAST(size AS VARCHAR)), substr(CAST(size AS VARCHAR), 1, 2),
           substr(md5(CAST(doc_id AS VARCHAR)), 1, 1), size, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place
      FROM d JOIN s USING (src)),
c AS (SELECT *, (start + (place + 1) * rate) // 268435456 - (start + place * rate) // 268435456 AS copies FROM q)
SELECT doc_id, size, n AS source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM c
"""
