import hashlib

import duckdb
import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from textlens.llm import bpe, mixing
from textlens.llm.queries import queries, tokenizer, toxicity_model

from .helpers import SF, odd_documents
from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_groups, brute_print


def brute(spark, sf):
    """The pipeline's rows (doc_id, ids), stage by stage without Spark's operators."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    score = toxicity_model(spark, sf, table).scorer()
    docs = [r for r in table.collect() if score(r.text or "")[0] < 0.5]
    kept = brute_lines([(r.doc_id, r.text) for r in docs], 40, 5)
    docs = [(r.doc_id, kept[r.doc_id, r.text or ""][0], r.source) for r in docs]
    prints = {i: brute_print(t) for i, t, _ in docs}
    g = brute_groups(prints.values())
    least = {}
    for i in sorted(prints):
        least.setdefault(g.find(prints[i]), i)
    docs = [d for d in docs if d[0] in set(least.values())]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs]}))
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE}) t").fetchall()}
    enc = bpe.encoder(*tokenizer())
    return sorted((i, tuple(enc.encode_ordinary(t))) for i, t, _ in docs for _ in range(copies[i]))


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = brute(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == want and len(want) > 20
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_stages_keep_the_columns_of_odd_documents(spark):
    docs = odd_documents(spark, ["n_lines", "SCORE", "copies", "component", "_llm_id", "row", "kept"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert 0 < out.count() <= 3 * docs.count(), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_registered_under_their_names():
    names = set(queries())
    assert names <= set(entry.queries()) and set(entry.oracle_sql()) >= {n for n in ("op5_mix_sources", "op7_line_dedup", "op12_bisector_clusters")}
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} >= {*range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
