"""Sources and sinks.

Every reader takes an explicit schema (no inference pass, columns pruned by
the schema) and every writer is a partitioned Spark writer.  Parquet is the
internal default; CSV/JSON exist for interchange with the source formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.prep import binarize_label, dialogue_text, safe_cast
from textlens.operators.triples import TRIPLE_COLS
from textlens.sources.keystore import KeyStore

# The tokens pandas' CSV reader turns into missing values.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_CSV = {"header": "true", "quote": '"', "escape": '"',
        # the CSV writer trims values unless told not to
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv(multi_line: bool) -> dict:
    """CSV options.  Fields with line breaks need ``multi_line``, and then a
    file is one task's work.  Without it files are split at line ends."""
    return {**_CSV, "multiLine": str(multi_line).lower()}


#: A file up to this size may be one task's work.
MAX_ONE_TASK_BYTES = 256 << 20


def _headered_csv(spark: SparkSession, path: str, multi_line: bool, max_file_bytes: int) -> DataFrame:
    """The columns of a headered CSV by name, as strings.  With ``multi_line``
    every file is one task's work, so a file beyond ``max_file_bytes`` is an
    error that names it: such data belong in many files (as Spark's writer
    makes them), or are read with ``multi_line=False`` if no field holds a line
    break."""
    if multi_line:
        # the listing alone: lengths and no content
        large = (spark.read.format("binaryFile").load(path).where(F.col("length") > max_file_bytes)
                 .select("path", "length").orderBy("path").limit(3).collect())
        if large:
            names = ", ".join(f"{r.path} ({r.length} bytes)" for r in large)
            raise ValueError(f"too large to be read with multi_line=True, one task a file: {names}")
    return spark.read.options(**_csv(multi_line)).option("inferSchema", "false").csv(path)


# ---------------------------------------------------------------- S01
def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``headline`` and ``is_sarcastic`` -> ``(text, label)``."""
    raw = spark.read.schema("headline STRING, is_sarcastic INT").json(path)
    return raw.select(F.col("headline").alias("text"), F.col("is_sarcastic").alias("label"))


# ---------------------------------------------------------------- S02
DIALOGUE_SCHEMA = "context ARRAY<STRING>, response STRING, label STRING, _corrupt_record STRING"


def _dialogue_lines(spark: SparkSession, path: str) -> DataFrame:
    parsed = F.from_json("value", DIALOGUE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    r = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("r")).select("value", "r.*")
    problem = (F.when(F.col("_corrupt_record").isNotNull(), "malformed line")
               .when(F.col("response").isNull(), "missing response"))
    return r.withColumn("problem", problem)


def read_dialogues(spark: SparkSession, path: str, positive: str = "SARCASM", skip_bad: bool = False) -> DataFrame:
    """Dialogue JSON lines (``context[]``, ``response``, ``label``) ->
    ``(text, label)``.  A malformed line or one without a response fails the
    job with that line; ``skip_bad`` leaves such lines out, and
    :func:`bad_dialogue_lines` lists them."""
    r = _dialogue_lines(spark, path)
    if skip_bad:
        r = r.where(F.col("problem").isNull())
    text = dialogue_text(F.coalesce("context", F.array().cast("array<string>")), F.col("response"))
    fail = F.raise_error(F.concat(F.col("problem"), F.lit(": "), F.col("value"))).cast("string")
    return r.select(F.when(F.col("problem").isNotNull(), fail).otherwise(text).alias("text"),
                    binarize_label("label", positive).alias("label"))


def bad_dialogue_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(problem, value)`` of the lines that are no dialogue."""
    return _dialogue_lines(spark, path).where(F.col("problem").isNotNull()).select("problem", "value")


# ---------------------------------------------------------------- S03 / S05
def read_labeled_csv(spark: SparkSession, path: str, extra_labels: Sequence[str] = (),
                     multi_line: bool = True, max_file_bytes: int = MAX_ONE_TASK_BYTES) -> DataFrame:
    """Headered RFC-4180 CSV (quotes doubled, embedded newlines) ->
    ``(text, label, *extra_labels)``.  Columns are found by header name (any
    order, other columns pruned, no inference pass); labels go through the
    guarded integer cast.  An empty field is NULL, as in pandas' reader.

    Fields may hold line breaks, so a file is one task's work, and one beyond
    ``max_file_bytes`` is refused; ``multi_line=False`` splits files of any size."""
    raw = _headered_csv(spark, path, multi_line, max_file_bytes)
    labels = ["label", *extra_labels]
    return raw.select(F.col("text"), *[safe_cast(c, "int").alias(c) for c in labels])


def write_labeled_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 headered CSV, no index column; empty strings stay quoted."""
    df.write.mode(mode).options(**_CSV).csv(path)


# ---------------------------------------------------------------- S04
def read_text_column(spark: SparkSession, path: str, col: str = "text", na: Sequence[str] = PANDAS_NA,
                     multi_line: bool = True, max_file_bytes: int = MAX_ONE_TASK_BYTES) -> DataFrame:
    """Only the text column of a headered CSV; pandas missing-value tokens
    become NULL and missing texts are dropped.  ``multi_line`` as in
    :func:`read_labeled_csv`."""
    # Column chosen by header name (no inference: every column is a string),
    # and the CSV parser prunes the others.
    raw = _headered_csv(spark, path, multi_line, max_file_bytes).select(col)
    c = F.when(F.col(col).isin(list(na)), None).otherwise(F.col(col))
    return raw.select(c.alias(col)).where(F.col(col).isNotNull())


# ---------------------------------------------------------------- S06
def write_terms(df: DataFrame, path: str, col: str = "term") -> None:
    """Sorted unique terms as JSON lines (one ``{"term": ...}`` per line)."""
    df.select(F.col(col).alias("term")).distinct().orderBy("term").write.mode("overwrite").json(path)


def write_terms_array(df: DataFrame, path: str, col: str = "term") -> None:
    """The source format: the sorted unique terms as one JSON array, parted by
    spaces.  Many tasks write a part each of a large vocabulary; the parts put
    together in the order of their names are the array.  Null terms are left out."""
    t = df.select(F.col(col).alias("term")).where(F.col("term").isNotNull()).distinct()
    quoted = F.to_json(F.array("term"))
    element = F.substring(quoted, 2, F.length(quoted) - 2)
    lead = F.when(F.col("term") == F.col("_first"), "").otherwise(",")
    first = t.agg(F.min("term").alias("_first"))
    elements = t.crossJoin(F.broadcast(first)).select(F.lit(1).alias("place"), "term", F.concat(lead, element).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, "", "["), (2, "", "]")], "place int, term string, value string")
    elements.union(ends).orderBy("place", "term").select("value").write.mode("overwrite").text(path, lineSep=" ")


def read_terms(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Distinct terms from JSON lines, or from JSON array files, each whole or
    a part of :func:`write_terms_array`."""
    if array_file:
        raw = spark.read.option("wholetext", "true").text(path)
        v = F.regexp_replace("value", r"^\s+|\s+$", "")
        v = F.when(v.startswith("["), v).otherwise(F.concat(F.lit("["), F.regexp_replace(v, "^,", "")))
        v = F.when(v.endswith("]"), v).otherwise(F.concat(v, F.lit("]")))
        t = raw.select(F.explode(F.from_json(v, "array<string>")).alias("term"))
    else:
        t = spark.read.schema("term STRING").json(path)
    return t.where(F.col("term").isNotNull()).distinct()


# ---------------------------------------------------------------- S07
class TermTable:
    """Keyed term store in hash buckets (:class:`KeyStore`).  ``merge_ignore``
    appends only keys not yet stored (INSERT OR IGNORE); it and ``lookup`` read
    the buckets of the given terms, ``get`` the files that can hold them."""

    SCHEMA = "term STRING NOT NULL, explanation STRING NOT NULL"

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        self.store = KeyStore(spark, path, self.SCHEMA, ["term"], n_buckets)

    def exists(self) -> bool:
        return bool(self.store.commits())

    def create_if_missing(self) -> TermTable:
        if not self.exists():
            self.store.append(self.store.read(), ["term"], commit=0)
        return self

    def read(self) -> DataFrame:
        return self.store.read()

    def count(self) -> int:
        return self.store.count()

    def lookup(self, terms: DataFrame, col: str = "term") -> DataFrame:
        """``terms`` with ``term`` and ``explanation`` of the stored term that
        equals ``col``, null where there is none."""
        stored = self.store.touched(terms.select(F.col(col).alias("term")))
        return terms.join(stored, terms[col] == stored["term"], "left")

    def get(self, terms: Sequence[str]) -> DataFrame:
        return self.store.get(terms)

    def merge_ignore(self, new: DataFrame, order: Sequence[str]) -> None:
        """Append the first row of each key not stored yet."""
        self.store.append(new.where(F.col("term").isNotNull()), order)


# ---------------------------------------------------------------- S08
_TRIPLE_DDL = "source_concept STRING, relation_type STRING, target_concept STRING, weight DOUBLE"


def triple_store(spark: SparkSession, path: str, n_buckets: int = 64) -> KeyStore:
    """Headered CSV files of triples in hash buckets; the first three columns are the key."""
    return KeyStore(spark, path, _TRIPLE_DDL, TRIPLE_COLS[:3], n_buckets, "csv", _CSV)


def append_triples(spark: SparkSession, batch: DataFrame, path: str, order: Sequence[str], n_buckets: int = 64) -> None:
    """Append a batch of triples to a store of headered CSV files, only keys not
    stored yet (first arrival per key inside the batch), reading only the buckets of the batch's keys."""
    triple_store(spark, path, n_buckets).append(batch, [*order, "weight"])


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of :func:`append_triples`, or of any folder of such CSV files."""
    store = triple_store(spark, path)
    if store.commits():
        return store.read().select(*TRIPLE_COLS)
    # concepts come from single lines, so no field holds a line break
    return spark.read.options(**_csv(False)).schema(_TRIPLE_DDL).csv(path).select(*TRIPLE_COLS)


# ---------------------------------------------------------------- S09
LABEL_SCHEMA = "text STRING, lang STRING, concept STRING"
EDGE_SCHEMA = "start STRING, relation STRING, end STRING, uri STRING"


def read_concept_graph(spark: SparkSession, labels_path: str, edges_path: str, fmt: str = "parquet",
                       **options) -> tuple[DataFrame, DataFrame]:
    """The concept graph as two tables: labels ``(text, lang, concept)`` and
    edges ``(start, relation, end, uri)``, read with explicit schemas (any
    file format Spark reads; ``spark.read.jdbc`` gives the same shape for a
    graph held in a database)."""
    labels = spark.read.format(fmt).options(**options).schema(LABEL_SCHEMA).load(labels_path)
    edges = spark.read.format(fmt).options(**options).schema(EDGE_SCHEMA).load(edges_path)
    return labels, edges


# ---------------------------------------------------------------- S10
def read_entity_bindings(spark: SparkSession, path: str, props: Sequence[str] = ("p31s", "p279s", "p527s", "p361s"),
                         multiline: bool = False) -> DataFrame:
    """Entity-search result documents (``results.bindings[]`` of
    ``{var: {type, value}}``) -> flat rows; qid is the last path element of
    the entity uri, a missing description or list becomes ``''``."""
    var = "STRUCT<type: STRING, value: STRING>"
    fields = ", ".join([f"entity: {var}", f"entityLabel: {var}", f"description: {var}",
                        *[f"{p}: {var}" for p in props]])
    schema = f"results STRUCT<bindings: ARRAY<STRUCT<{fields}>>>"
    raw = spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)
    b = raw.select(F.explode("results.bindings").alias("b"))
    return b.select(
        F.element_at(F.split("b.entity.value", "/"), -1).alias("qid"),
        F.col("b.entityLabel.value").alias("label"),
        F.coalesce("b.description.value", F.lit("")).alias("description"),
        *[F.coalesce(f"b.{p}.value", F.lit("")).alias(p) for p in props],
    )


def write_entity_bindings(cands: DataFrame, path: str, group: str = "term",
                          props: Sequence[str] = ("p31s", "p279s", "p527s", "p361s"),
                          base: str = "http://www.wikidata.org/entity/") -> None:
    """One result document per ``group`` value, in the entity-search shape."""
    def v(c, kind="literal"):
        return F.struct(F.lit(kind).alias("type"), c.alias("value"))

    binding = F.struct(v(F.concat(F.lit(base), F.col("qid")), "uri").alias("entity"),
                       v(F.col("label")).alias("entityLabel"),
                       F.when(F.col("description") != "", v(F.col("description"))).alias("description"),
                       *[v(F.col(p)).alias(p) for p in props])
    docs = cands.groupBy(group).agg(F.collect_list(binding).alias("bindings"))
    docs.select(F.struct("bindings").alias("results")).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- S11
def write_results(pred: DataFrame, metrics_long: DataFrame, out_dir: str) -> None:
    """Predictions as headered CSV and metrics as ``(metric, value)`` rows."""
    pred.write.mode("overwrite").options(**_CSV).csv(f"{out_dir}/predictions")
    metrics_long.select("metric", F.col("value").cast("double")).write.mode("overwrite").options(**_CSV).csv(
        f"{out_dir}/metrics")


def read_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.options(**_csv(False)).schema("metric STRING, value DOUBLE").csv(f"{out_dir}/metrics")


def read_predictions(spark: SparkSession, out_dir: str, schema: str, multi_line: bool = False) -> DataFrame:
    """The predictions of :func:`write_results`, in the writer's column order;
    ``multi_line`` if a text column may hold line breaks."""
    return spark.read.options(**_csv(multi_line)).schema(schema).csv(f"{out_dir}/predictions")
