"""Line de-duplication (DataFrame functions only).

Lines are exploded and normalised, their keys hashed once (md5, 128 bits) into
a narrow table, and documents counted per hash: first one row per (hash, document), then a count
that Spark combines before its shuffle, so a line of a third of all documents
reaches its reducer as one row per task.  Frequent hashes meet the lines
again in a join (a hot hash is split by adaptive skew handling), which gives
each document the positions it loses; whole texts are shuffled once, to meet
their positions, and are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import WS_CHARS, ascii_lower, staged


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text_col`` cleaned, plus ``n_lines`` (before dropping)
    and ``n_dropped``.

    A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both
    ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code points
    in at least ``min_docs`` different documents lose all their lines except
    those of the largest id holding them.

    A null or empty text is one empty line and comes back as ''.  Rows with
    one id are one document when documents are counted; null ids are together
    one document, smaller than any other.  Each row keeps its own text.  An
    empty table gives an empty result.  An input column with the name of an
    output column is left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c.lower() not in {x.lower() for x in (id_col, text_col, n_lines, n_dropped)}]
    held = {c: f"_llm_in_{i}" for i, c in enumerate(rest)}  # under names that clash with nothing here
    split = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()],
                        F.col(id_col).alias("_llm_id"), F.xxhash64(text).alias("_llm_text"),
                        F.split(text, "\n", -1).alias("_llm_lines"))
    line = split.select("_llm_id", "_llm_text", F.posexplode("_llm_lines").alias("_llm_pos", "_llm_line"))
    bare = F.btrim(F.col("_llm_line"), F.lit(WS_CHARS))
    # lower-casing keeps the length, so short lines are left out before it
    line = line.where(F.char_length(bare) >= min_chars).select(
        "_llm_id", "_llm_text", "_llm_pos", F.unhex(F.md5(ascii_lower(bare).cast("binary"))).alias("_llm_hash"))
    line = staged(line, "line-hashes")  # read twice below; hashing every line costs more than this narrow table
    frequent = (line.groupBy("_llm_hash", "_llm_id").agg(F.lit(1))
                .groupBy("_llm_hash").agg(F.count(F.lit(1)).alias("_llm_docs"), F.max("_llm_id").alias("_llm_keep"))
                .where(F.col("_llm_docs") >= min_docs).select("_llm_hash", "_llm_keep"))
    # written: its measured size decides the join, and a hot hash of the lines can be split there
    frequent = staged(frequent, "frequent-lines")
    drops = (line.join(frequent, "_llm_hash").where(~F.col("_llm_id").eqNullSafe(F.col("_llm_keep")))
             .groupBy("_llm_id", "_llm_text").agg(F.collect_set("_llm_pos").alias("_llm_drop"))
             .select(F.col("_llm_id").alias("_llm_id2"), F.col("_llm_text").alias("_llm_text2"), "_llm_drop"))
    met = split.join(drops, F.col("_llm_id").eqNullSafe(F.col("_llm_id2"))
                     & (F.col("_llm_text") == F.col("_llm_text2")), "left")
    n = F.array_size("_llm_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_llm_drop"))
    kept = F.transform(kept, lambda i: F.element_at(F.col("_llm_lines"), i + 1))
    lines = F.when(F.col("_llm_drop").isNull(), F.col("_llm_lines")).otherwise(kept)
    made = {id_col: F.col("_llm_id"), text_col: F.array_join(lines, "\n"), **{c: F.col(h) for c, h in held.items()}}
    return met.select(*[made[c].alias(c) for c in docs.columns if c in made],
                      n.cast("long").alias(n_lines),
                      F.coalesce(F.array_size("_llm_drop"), F.lit(0)).cast("long").alias(n_dropped))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
