"""Exact uniform shuffle into shards (DataFrame functions only).

1. Rows fall into cells by a hash of their content; cells are counted.
2. A communication matrix says how many rows each cell sends to each shard.
   Its rows follow the multivariate hypergeometric law given the cell sizes
   and the exact shard sizes: what a uniform permutation of all rows would
   send.  It is drawn cell by cell, each shard's share a hypergeometric
   variate by inversion of its distribution function (a sum over the counts
   within 12 standard deviations; what lies beyond is below 1e-30).
   Many rows have many cells: then cells of cells are drawn first, and each
   splits its own row of the matrix among its cells by the same law, each in
   a task of its own.
3. Inside a cell rows are permuted (ranked by a keyed hash) and dealt to the
   shards by the cell's counts, then exchanged.
4. Inside a shard rows are permuted again: ranked by a second keyed hash, in
   blocks of that hash's leading bits, so no task holds a whole shard.

Rows equal in content are one row with a count until they have their slots: a
row that a third of the table repeats is ranked, dealt and sent as one, and
written out again in many parts.  Cells and blocks hold about a million
different rows each, so their numbers follow from the table's.

All randomness comes from hashes of (seed, content), so a recomputed task or a
rerun on other partitions gives the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import staged


def _uniform(*parts: Column) -> Column:
    """A double in [0, 1) from a hash of ``parts`` (53 bits)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """Number of good items among ``drawn`` of ``total`` without replacement,
    the variate of the uniform ``u``: weights relative to the lowest count
    follow from their ratio, are summed, and the first count whose running
    sum passes ``u`` of the whole is taken."""
    p = F.when(total > 0, good / total).otherwise(F.lit(0.0))
    mean = drawn * p
    sd = F.sqrt(F.greatest(mean * (1 - p), F.lit(0.0)))
    lo = F.greatest(F.lit(0), drawn + good - total, F.floor(mean - 12 * sd - 30)).cast("long")
    hi = F.least(drawn, good, F.ceil(mean + 12 * sd + 30)).cast("long")

    def draw(v: Column) -> Column:
        def after(a: Column, k: Column) -> Column:  # the weight of k + 1
            up = (v["good"] - k).cast("double") * (v["drawn"] - k).cast("double")
            down = (k + 1).cast("double") * (v["rest"] + k + 1).cast("double")
            return F.when(k < v["hi"], a["w"] * up / down).otherwise(F.lit(0.0))

        counts = F.sequence(v["lo"], v["hi"])
        whole = F.aggregate(counts, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
                            lambda a, k: F.struct(after(a, k).alias("w"), (a["s"] + a["w"]).alias("s")),
                            lambda a: a["s"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), v["lo"].alias("k"), (whole * v["u"]).alias("aim"))
        return F.aggregate(counts, start, lambda a, k: F.struct(
            after(a, k).alias("w"), (a["s"] + a["w"]).alias("s"),
            F.when(a["s"] <= a["aim"], k).otherwise(a["k"]).alias("k"), a["aim"].alias("aim")), lambda a: a["k"])

    return _let(F.struct(good.alias("good"), drawn.alias("drawn"), (total - good - drawn).alias("rest"),
                         lo.alias("lo"), hi.alias("hi"), u.alias("u")), draw)


#: Cells drawn in one row; a level of cells of cells has as many.
FAN = 256
#: Different rows that a cell or a block should hold.
CELL_ROWS = 1 << 20
_PART = 1 << 14  # equal rows written out at a time


def _dealt(groups: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``(cell, sent)`` for the cells of every row of ``groups(cs, sizes)``:
    ``cs`` their numbers and sizes, in order, ``sizes`` what each shard takes of them together."""

    def deal(room: Column, cell: Column) -> Column:
        """The cell's counts, given what the shards still have room for."""
        left = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.array().cast("array<bigint>").alias("sent"), cell["n"].alias("drawn"), left.alias("left"))

        def one_shard(a: Column, j: Column) -> Column:
            good = F.element_at(room, j)
            x = _hypergeometric(good, a["left"], a["drawn"], _uniform(F.lit(seed), cell["cell"], j))
            return _let(x, lambda v: F.struct(F.concat(a["sent"], F.array(v)).alias("sent"),
                                              (a["drawn"] - v).alias("drawn"), (a["left"] - good).alias("left")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, one_shard, lambda a: a["sent"])

    def next_cell(state: Column, cell: Column) -> Column:
        return _let(deal(state["room"], cell), lambda sent: F.struct(
            F.zip_with(state["room"], sent, lambda r, x: r - x).alias("room"),
            F.concat(state["out"], F.array(F.struct(cell["cell"].alias("cell"), sent.alias("sent")))).alias("out")))

    empty = F.array().cast("array<struct<cell:int,sent:array<bigint>>>")
    rows = F.aggregate("cs", F.struct(F.col("sizes").alias("room"), empty.alias("out")), next_cell, lambda s: s["out"])
    return groups.select(F.explode(rows).alias("r")).select("r.cell", "r.sent")


def communication_matrix(cells: DataFrame, n_shards: int, seed: int, levels: int = 1) -> DataFrame:
    """``(cell, sent)`` from ``cells(cell, n)``: ``sent`` has the rows that the
    cell sends to each shard.  Rows sum to the cells' sizes, columns to shard
    sizes at most one apart (the first shards are the larger ones).  With
    ``levels`` cells are numbered below ``FAN ** levels`` and one row draws at
    most ``FAN`` of them, however many rows the table has."""
    held = F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cs")
    if levels > 1:
        above = cells.groupBy(F.expr(f"cell div {FAN}").cast("int").alias("cell")).agg(F.sum("n").alias("n"))
        above = staged(communication_matrix(above, n_shards, seed, levels - 1), "matrix-above")
        groups = cells.groupBy(F.expr(f"cell div {FAN}").cast("int").alias("above")).agg(held)
        groups = groups.join(above.select(F.col("cell").alias("above"), F.col("sent").alias("sizes")), "above")
        return _dealt(groups, n_shards, seed + 1_000_003 * (levels - 1))
    total = F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    sizes = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda j: (
        F.floor(F.col("total") / n_shards) + F.when(j < F.col("total") % n_shards, 1).otherwise(0)).cast("long"))
    one = cells.agg(held).select("cs", total.alias("total"))
    return _dealt(one.select("cs", sizes.alias("sizes")), n_shards, seed)


def shuffle_to_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16,
                      cell_rows: int = CELL_ROWS, seed: int = 9, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns, ``id_col``, ``size``
    (UTF-8 bytes of the text, null none, plus 1), ``text_crc32`` (null as
    empty), ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... without gaps
    in each shard): a uniform shuffle whose shard counts are at most one apart.

    Null ids are ids like any other.  Rows equal in id, text and carried
    columns are interchangeable; their slots follow each other.  An empty table
    gives an empty result.  Texts of any length count by their bytes.  A carried
    column with the name of an output column is left out; carried columns must
    be of types that can be grouped (no maps).  Narrow rows (carried columns,
    id, size, crc32, count) are staged once; about ``cell_rows`` of them share a cell or a block.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in carry if c.lower() not in {id_col.lower(), "size", "text_crc32", "shard", "slot"}]
    held = [f"_llm_in_{i}" for i in range(len(kept))]  # under names that clash with nothing here
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(kept, held)], F.col(id_col).alias("_llm_id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    names = [*held, "_llm_id", "size", "text_crc32"]
    # equal rows are combined in each task before they meet
    rows = staged(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_llm_n")), "shard-rows")
    n = rows.count()  # from the files' footers
    levels = 1
    while FAN ** levels * cell_rows < n and levels < 3:
        levels += 1
    n_blocks = max(FAN, -(-n // (n_shards * cell_rows)))
    content = [F.col(c) for c in names]
    rows = rows.select("*", F.pmod(F.xxhash64(F.lit(seed), *content), FAN ** levels).cast("int").alias("cell"))
    matrix = staged(communication_matrix(rows.groupBy("cell").agg(F.sum("_llm_n").alias("n")), n_shards, seed, levels), "matrix")

    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.aggregate(
        F.slice("sent", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x))
    local = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), *content), *content)
    matrix = matrix.select("cell", ends.alias("ends"))
    # FAN rows of n_shards counts; more are joined as the planner sees fit
    dealt = rows.join(F.broadcast(matrix) if levels == 1 else matrix, "cell")
    dealt = dealt.withColumn("_llm_last", F.sum("_llm_n").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_llm_last") - F.col("_llm_n")

    def share(end: Column, j: Column) -> Column:  # of ranks first + 1 to last the shard's, which end behind the one before
        begin = F.when(j == 0, F.lit(0).cast("long")).otherwise(F.get("ends", j - 1))
        return F.struct(j.alias("shard"), (F.least(end, F.col("_llm_last")) - F.greatest(begin, first)).alias("n"))

    shares = F.filter(F.transform("ends", share), lambda x: x["n"] > 0)
    key = F.xxhash64(F.lit(seed + 2), *content)
    # blocks in the order of the key, so that (block, key) sorts as the key does
    block = F.floor((key.cast("double") / 2.0 ** 64 + 0.5) * n_blocks).cast("int")
    sent = staged(dealt.select(*names, key.alias("_llm_key"), block.alias("_llm_block"), F.inline(shares)), "exchange")

    blocks = sent.groupBy("shard", "_llm_block").agg(F.sum("n").alias("_llm_rows"))
    earlier = Window.partitionBy("shard").orderBy("_llm_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "_llm_block", F.coalesce(F.sum("_llm_rows").over(earlier), F.lit(0)).alias("_llm_before"))
    inside = Window.partitionBy("shard", "_llm_block").orderBy("_llm_key", *content).rowsBetween(Window.unboundedPreceding, 0)
    placed = sent.join(F.broadcast(blocks) if n_shards * n_blocks <= 100_000 else blocks, ["shard", "_llm_block"])
    placed = placed.withColumn("_llm_slot", F.col("_llm_before") + F.sum("n").over(inside) - F.col("n"))
    return _written_out(placed, "n", "_llm_slot").select(
        *[F.col(h).alias(c) for c, h in zip(kept, held)], F.col("_llm_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _written_out(rows: DataFrame, count: str, first: str) -> DataFrame:
    """Each row ``count`` times, with ``slot`` counting from ``first``.  Rows
    with many copies are parted and dealt over all tasks before they are written out."""
    last = F.col(first) + F.col(count) - 1
    few = rows.where(F.col(count) <= _PART).withColumn("slot", F.explode(F.sequence(F.col(first), last)))
    parts = rows.where(F.col(count) > _PART).withColumn("_llm_from", F.explode(F.sequence(F.col(first), last, F.lit(_PART).cast("long"))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = parts.repartition(n, F.xxhash64("_llm_from", first)).withColumn(
        "slot", F.explode(F.sequence("_llm_from", F.least(last, F.col("_llm_from") + _PART - 1)))).drop("_llm_from")
    return few.union(many)
