"""Queries over the given tables, one per training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import (alignment, bisectors, bpe, line_dedup, mixing, neighbours, quality, repetition, sharding, simhash, substrings,
                          suffixes, toxicity)
from textlens.llm.common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), *tokenizer(), with_ids=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed spans of passages, wherever they begin and end."""
    return substrings.repeated_passages(_documents(spark, sf_dir)).drop("text_hash")


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed spans with whole sentences as units."""
    return substrings.repeated_spans(_documents(spark, sf_dir)).drop("text_hash")


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_documents(spark, sf_dir)).drop("spans")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.NoisyOr:
    labels = _table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0)
    return toxicity.fit_on(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "n_sentences", F.array_size("offending").cast("long").alias("n_offending"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_documents(spark, sf_dir))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select(
        F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir)).drop("component")


def op9_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"),
                                    crc_fold("doc_id", 4) != 2)
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(_documents(spark, sf_dir), with_text=False)


def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = bisectors.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(d) for d in centroids.digests()]).cast("array<string>")
    return rows.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, with_groups=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_byte_bpe, op2_substring_dedup, op3_repetition_rules, op4_toxicity, op5_mix_sources,
            op6_nearest_vectors, op7_line_dedup, op8_simhash, op9_shuffle_shards, op10_quality_classifier,
            op11_suffix_dedup, op12_bisector_clusters, op13_align_tokenizers, sentence_dedup, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"sentence_dedup": substrings.ORACLE, "op5_mix_sources": mixing.ORACLE,
            "op7_line_dedup": line_dedup.ORACLE, "op12_bisector_clusters": bisectors.oracle()}
