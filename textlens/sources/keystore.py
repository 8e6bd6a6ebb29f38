"""A keyed table in hash buckets with a commit list (behind S07, S08, J07, R01).

Rows lie in ``<path>/data/commit=<n>/bucket=<b>/``, where the bucket follows
from the key's hash.  ``<path>/commits/<n>`` lists what commit ``n`` holds per
bucket: files, rows and smallest and largest first key.  It is written last,
as one file, so a commit is either listed whole or not there; data of a run
that was lost before is overwritten by the next.

What an operation reads follows from the list: an append or a lookup reads the
buckets that its keys fall into, and the number of stored rows is a sum over
the list.  One commit of :meth:`KeyStore.compact` replaces all before it.  A
store has one writer at a time and any number of readers: a second writer of
the same commit number fails.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "number LONG, replaces BOOLEAN, buckets ARRAY<STRUCT<bucket: INT, n_rows: LONG, low: STRING, high: STRING>>"


@dataclass(frozen=True)
class Part:
    """One bucket of one commit."""

    commit: int
    bucket: int
    n_rows: int
    low: str
    high: str


class KeyStore:
    """Rows of ``schema`` (DDL), unique in ``keys``, in ``n_buckets`` buckets.

    ``n_buckets`` and ``bucket_by`` (the key columns that decide the bucket, all by
    default) belong to the store's layout: use the same at every call.  Null keys are kept as keys of their own.  ``fmt`` and ``options`` are those
    of Spark's readers and writers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], n_buckets: int = 64,
                 fmt: str = "parquet", options: Mapping[str, str] | None = None, bucket_by: Sequence[str] | None = None):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.schema: T.StructType = spark.createDataFrame([], schema).schema
        self.keys, self.n_buckets, self.options = list(keys), n_buckets, dict(options or {})
        self.bucket_by = list(bucket_by or keys)
        if fmt == "parquet":  # a few keys are found in the footers and Bloom filters of sorted files
            self.options |= {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}

    # ------------------------------------------------------------ the list
    def commits(self) -> list:
        """Commits in force, oldest first: one small row each."""
        try:
            rows = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits/*").collect()
        except AnalysisException:  # no commit yet
            return []
        rows.sort(key=lambda r: r.number)
        last = max((i for i, r in enumerate(rows) if r.replaces), default=0)
        return rows[last:]

    def parts(self, buckets: set[int] | None = None) -> list[Part]:
        """The stored parts, of the given buckets only if any are given."""
        return [Part(c.number, b.bucket, b.n_rows, b.low, b.high) for c in self.commits() for b in c.buckets
                if buckets is None or b.bucket in buckets]

    def count(self, parts: Sequence[Part] | None = None) -> int:
        """Stored rows, from the commit list alone."""
        return sum(p.n_rows for p in (self.parts() if parts is None else parts))

    def next_commit(self) -> int:
        found = self.commits()
        return found[-1].number + 1 if found else 0

    # ------------------------------------------------------------ reading
    def _bucket(self) -> Column:
        # the keys as text, so that the bucket does not hang on how a reader types a column
        names = {f.name: f.dataType for f in self.schema}
        return F.pmod(F.xxhash64(*[F.col(k).cast(names[k]).cast("string") for k in self.bucket_by]), F.lit(self.n_buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """Buckets that the keys of ``rows`` fall into (at most ``n_buckets`` numbers)."""
        return {r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def _read(self, parts: Sequence[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        root = f"{self.path}/data"
        whole = T.StructType([*self.schema.fields, T.StructField("commit", T.LongType()), T.StructField("bucket", T.IntegerType())])
        df = (self.spark.read.format(self.fmt).options(**self.options).schema(whole).option("basePath", root)
              .load([f"{root}/commit={p.commit}/bucket={p.bucket}" for p in parts]))
        return df.select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._read(self.parts())

    def touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the keys of ``rows`` fall into."""
        return self._read(self.parts(self.buckets_of(rows)))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the stored values of their keys, null where there is none."""
        return rows.join(self.touched(rows), self.keys, "left")

    def get(self, values: Sequence) -> DataFrame:
        """The stored rows of some values of a single key column: a point
        lookup.  Buckets come from the values, files whose range holds none of
        them are left out by the commit list, row groups by Parquet's
        statistics and Bloom filters (the condition is pushed to the scan)."""
        key = self.keys[0]
        if len(self.keys) > 1:
            raise ValueError("a point lookup needs a single key column")
        asked = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, self.schema[key].dataType)]))
        of: dict[int, list[str]] = {}
        for r in asked.select(self._bucket().alias("b"), F.col(key).cast("string").alias("v")).collect():
            of.setdefault(r.b, []).append(r.v)
        parts = [p for p in self.parts(set(of)) if p.low is None or any(v is not None and p.low <= v <= p.high for v in of[p.bucket])]
        hit = F.lit(False)
        for v in values:  # single comparisons: a long IN list would be pushed as a range only
            hit = hit | (F.col(key) == F.lit(v))
        return self._read(parts).where(hit)

    # ------------------------------------------------------------ writing
    def new_rows(self, rows: DataFrame, order: Sequence[str], parts: Sequence[Part] | None = None) -> DataFrame:
        """The first row, by ``order``, of every key of ``rows`` that is not
        stored; with the columns of ``order``."""
        names = self.schema.names
        first = rows.groupBy(*self.keys).agg(F.min_by(
            F.struct(*[c for c in dict.fromkeys([*names, *order]) if c not in self.keys]), F.struct(*order)).alias("_r"))
        first = first.select(*self.keys, "_r.*")
        stored = self.touched(rows) if parts is None else self._read(parts)
        return first.join(stored.select(*[F.col(k).alias(f"_stored_{k}") for k in self.keys]),
                          [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in self.keys], "left_anti")

    def append(self, rows: DataFrame, order: Sequence[str], commit: int | None = None, limit: int | None = None) -> int:
        """Store the first row of every key not stored yet; with ``limit``, the
        first so many rows by ``order``.  Returns the commit's number.  A
        number that is listed already is not written again, so a replayed
        batch changes nothing."""
        listed = {c.number for c in self.commits()}
        number = commit if commit is not None else self.next_commit()
        if number in listed:
            return number
        rows = rows.persist(StorageLevel.DISK_ONLY)  # read for its buckets, then for its rows
        try:
            new = self.new_rows(rows, order)
            if limit is not None:
                new = new.orderBy(*order, *self.keys).limit(max(limit, 0))
            return self._write(new.select(*self.schema.names), number, False)
        finally:
            rows.unpersist()

    def _write(self, rows: DataFrame, number: int, replaces: bool, mode: str = "errorifexists") -> int:
        out = f"{self.path}/data/commit={number}"
        # the rows of a bucket stand together and sorted: one file a bucket, or a few of a large one
        (rows.withColumn("bucket", self._bucket()).repartition(self.n_buckets, "bucket").sortWithinPartitions("bucket", *self.keys)
         .write.partitionBy("bucket").mode("overwrite").format(self.fmt).options(**self.options).save(out))
        held = (self.spark.read.format(self.fmt).options(**self.options)
                .schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).load(out))
        first = F.col(self.keys[0]).cast("string")
        per = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min(first).alias("low"), F.max(first).alias("high"))
        entry = per.agg(F.sort_array(F.collect_list(F.struct("bucket", "n_rows", "low", "high"))).alias("buckets"))  # n_buckets rows
        (entry.select(F.lit(number).cast("long").alias("number"), F.lit(replaces).alias("replaces"), "buckets").coalesce(1)
         .write.mode(mode).json(f"{self.path}/commits/{number}"))
        return number

    def compact(self) -> int:
        """One commit that holds all stored rows, a sorted file or a few per
        bucket, and replaces the others.  Files of replaced commits stay until
        they are removed from outside, so readers under way are not disturbed."""
        return self._write(self.read(), self.next_commit(), True)
