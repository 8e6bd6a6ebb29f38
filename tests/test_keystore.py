"""The bucketed key store: what an operation reads, replays, lost runs, and its tables S07, S08, R01."""

import random

import pytest
from pyspark.sql import functions as F

from textlens.session import scratch_dir
from textlens.sources import io as IO
from textlens.sources.keystore import KeyStore

DDL = "k STRING, v LONG"


def table(spark, rows):
    return spark.createDataFrame(rows, "k STRING, v LONG, o LONG")


def store(spark, n=16, **options):
    return KeyStore(spark, scratch_dir(spark, "t-ks"), DDL, ["k"], n, **options)


def rows_of(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_appends_equal_insert_or_ignore(spark, seed):
    rnd, s, want = random.Random(seed), store(spark), {}
    for commit in range(5):
        batch = [(rnd.choice([None, "", f"k{rnd.randint(0, 60)}"]), rnd.randint(0, 9), i) for i in range(rnd.choice([0, 1, 40]))]
        s.append(table(spark, batch), ["o"])
        for k, v, _ in batch:
            want.setdefault(k, v)
        assert rows_of(s.read()) == sorted(want.items(), key=repr) and s.count() == len(want)
    s.compact()
    assert rows_of(s.read()) == sorted(want.items(), key=repr) and s.count() == len(want) and len(s.commits()) == 1
    s.append(table(spark, [("new", 1, 1), (None, 5, 2)]), ["o"])
    want.setdefault(None, 5)
    assert s.count() == len({**want, "new": 1})


def test_an_append_reads_the_files_of_its_buckets_only(spark):
    s = store(spark, 100)
    for c in range(3):
        s.append(spark.range(c * 5000, (c + 1) * 5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.col("id").alias("o")), ["o"])
    every = s.read().inputFiles()
    one = table(spark, [("7", 0, 0)])
    read = s.touched(one).inputFiles()
    assert len(every) == 300 and len(read) == 3
    assert {f.split("bucket=")[1].split("/")[0] for f in read} == {str(b) for b in s.buckets_of(one)}
    # the plan of the append reads no others
    assert len([f for f in s.new_rows(one, ["o"]).inputFiles() if "bucket=" in f]) == 3
    s.append(table(spark, [("7", 0, 0), ("new", 1, 1)]), ["o"])
    assert s.count() == 15_001 and len(s.parts()) <= 302


def test_the_count_reads_the_commit_list_alone(spark):
    s = store(spark)
    s.append(table(spark, [(f"k{i}", i, i) for i in range(50)]), ["o"])
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{s.path}/data")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).rename(root, spark._jvm.org.apache.hadoop.fs.Path(f"{s.path}/moved"))
    assert s.count() == 50


def test_a_replayed_commit_changes_nothing_and_a_lost_one_is_written_again(spark):
    s = store(spark)
    s.append(table(spark, [("a", 1, 1)]), ["o"], commit=0)
    s.append(table(spark, [("b", 2, 1)]), ["o"], commit=0)
    assert rows_of(s.read()) == [("a", 1)]
    # data without an entry in the list: a run that was lost before its commit
    table(spark, [("lost", 9, 9)]).select("k", "v", F.lit(3).alias("bucket")).write.partitionBy("bucket").parquet(f"{s.path}/data/commit=1")
    assert rows_of(s.read()) == [("a", 1)]
    s.append(table(spark, [("b", 2, 1)]), ["o"], commit=1)
    assert rows_of(s.read()) == [("a", 1), ("b", 2)]


def test_limits_take_the_first_new_rows(spark):
    s = store(spark)
    s.append(table(spark, [("b", 2, 1), ("a", 1, 5), ("c", 3, 3)]), ["o"], limit=2)
    assert rows_of(s.read()) == [("b", 2), ("c", 3)]
    s.append(table(spark, [("d", 2, 1), ("e", 1, 5)]), ["o"], limit=0)
    assert s.count() == 2


def test_point_lookup_prunes_and_pushes(spark):
    s = store(spark, 8)
    for c in range(4):  # commits of apart ranges: the list alone rules three of four out
        s.append(spark.range(2000).select(F.concat(F.lit("abcd"[c]), F.format_string("%05d", "id")).alias("k"), F.col("id").alias("v"), F.col("id").alias("o")), ["o"])
    got = s.get(["a00007", "a01999", "zzz", "it's"])
    assert rows_of(got) == [("a00007", 7), ("a01999", 1999)]
    assert len(got.inputFiles()) <= 2 and "PushedFilters: [Or(" in got._jdf.queryExecution().toString()
    assert s.get([]).collect() == [] and s.get(["nothing like it"]).collect() == []
    assert rows_of(s.lookup(spark.createDataFrame([("c00003",), ("none",), (None,)], "k STRING"))) == [("c00003", 3), ("none", None), (None, None)]


def test_several_keys_in_csv_files(spark):
    root = scratch_dir(spark, "t-csv")
    s = KeyStore(spark, root, "a STRING, b INT, w DOUBLE", ["a", "b"], 4, "csv", {"header": "true"})
    kind = "a STRING, b INT, w DOUBLE, o INT"
    s.append(spark.createDataFrame([("x", 1, 0.5, 1), ("x", 2, 0.6, 2), ("x", 1, 0.7, 0)], kind), ["o"])
    s.append(spark.createDataFrame([("x", 1, 9.0, 1), ("y", 1, 0.9, 2)], kind), ["o"])
    assert sorted(map(tuple, s.read().collect())) == [("x", 1, 0.7), ("x", 2, 0.6), ("y", 1, 0.9)]
    with pytest.raises(ValueError):
        s.get(["x"])


def test_term_table(spark):
    t = IO.TermTable(spark, scratch_dir(spark, "t-terms"), n_buckets=8).create_if_missing().create_if_missing()
    assert t.exists() and t.read().collect() == [] and t.count() == 0
    t.merge_ignore(spark.createDataFrame([("Sun", "late", 2), ("Sun", "first", 1), ("moon", "m", 3), (None, "no", 0)], "term STRING, explanation STRING, o INT"), ["o"])
    t.merge_ignore(spark.createDataFrame([("Sun", "again", 0), ("star", "s", 0)], "term STRING, explanation STRING, o INT"), ["o"])
    assert sorted(map(tuple, t.read().collect())) == [("Sun", "first"), ("moon", "m"), ("star", "s")] and t.count() == 3
    found = t.lookup(spark.createDataFrame([("Sun", 1), ("sun", 2)], "word STRING, n INT"), "word")
    assert sorted((r.word, r.n, r.explanation) for r in found.collect()) == [("Sun", 1, "first"), ("sun", 2, None)]
    assert [tuple(r) for r in t.get(["moon"]).collect()] == [("moon", "m")]


def test_large_files_are_not_read_in_one_task_unasked(spark):
    path = scratch_dir(spark, "t-large")
    IO.write_labeled_csv(spark.createDataFrame([("a\nb", 1), ("c", 0)], "text STRING, label INT").coalesce(1), path)
    assert IO.read_labeled_csv(spark, path).count() == 2
    for read in (IO.read_labeled_csv, IO.read_text_column):
        with pytest.raises(ValueError, match="part-"):
            read(spark, path, max_file_bytes=5)
        assert read(spark, path, multi_line=False, max_file_bytes=5).count() >= 2
