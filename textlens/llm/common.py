"""Column expressions and table helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.session import scratch_dir

#: White space of the word and line rules, as a regex class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{WS_CLASS}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and every other character unchanged."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def staged(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: computed once, pruned by column, and safe against lost executors.
    Its place is added to ``paths``, for :func:`released`."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, paths: list[str]) -> None:
    """Free the space of staged tables that nothing reads any more, by writing
    empty ones over them."""
    while paths:
        spark.range(0).write.mode("overwrite").parquet(paths.pop())


def label_of(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)`` with one row per labelled document: labels other than 0
    and 1 and null ids are ignored, and of differing labels the larger wins."""
    return (labels.select(id_col, F.col(label).cast("int").alias("label"))
            .where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
            .groupBy(id_col).agg(F.max("label").alias("label")))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
