"""Corpus pipeline over ``documents``: toxic documents go, repeated lines go,
one document of each near-duplicate group stays, sources are mixed to their
target weights, and the mix is tokenised.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import bpe, line_dedup, mixing, simhash, toxicity
from textlens.llm.common import released, staged
from textlens.llm.queries import tokenizer, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; learnt from the training labels of ``sf_dir``.

    A null text is scored as an empty one; whole texts of any length are
    scored, sentence by sentence.  Rows are judged one by one, so repeated rows
    stay or go together and ties do not arise; null ids pass through.  An empty
    table stays empty.  Extra columns, whatever their names, pass through."""
    model = toxicity_model(spark, sf_dir, docs)
    inner = docs.toDF(*[f"_llm_in_{c}" for c in docs.columns])  # no name of docs can clash with a result's
    scored = toxicity.score_documents(inner, model, id_col="_llm_in_doc_id", text_col="_llm_in_text",
                                      carry=tuple(inner.columns))
    return scored.where("score < 0.5").select(*[F.col(f"_llm_in_{c}").alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of many documents; ``n_chars`` follows the text.

    A null text has one empty line and loses none; it comes back empty or null as
    :func:`textlens.llm.line_dedup.dedup_lines` states.  A text keeps its row even if all its lines go.
    Repeated rows count as one document and are cut alike; of documents tied
    on a line the largest id keeps it.  Texts of any length are split whole, an empty
    table stays empty, extra columns of any names pass through."""
    out = line_dedup.dedup_lines(docs, n_lines="_llm_n_lines", n_dropped="_llm_n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: 3-word shingles, at most 3 differing bits.

    Texts without words, null or empty, share the zero fingerprint and are one
    group; very long texts are fingerprinted whole.  Of a group the smallest id
    stays, a row with a null id only where there is no other; of repeated rows one
    stays.  An empty table stays empty, extra columns of any names pass through."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null or empty text has no words and is taken at its source's rate like
    any other; a null source is a source of its own.  Ties in size are ordered by a hash of the
    id, repeated rows by a hash of all columns.  Very long texts
    are taken whole or not at all.  An empty table stays empty, extra columns
    of any names pass through."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of ids and decoded bytes.

    A null text has no tokens.  Very long texts are encoded in parts cut where
    no token crosses.  Each row gives one row, repeated ones too; ids, null ones too,
    pass through; an empty table gives an empty result.  Other columns are not
    read."""
    return bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Training and the fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and reread;
    what a stage was given is freed when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        after: list[str] = []
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", after)
        released(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
