import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import quality
from textlens.llm.queries import op10_quality_classifier

from .helpers import connection, no_documents, odd_documents

SF = "/root/testdata/sf0.1"


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        rank[p == v] = rank[p == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_documents(spark):
    con = connection(SF)
    truth = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = op10_quality_classifier(spark, SF).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    p, s, y = (np.array(x, float) for x in zip(*held))
    assert auc(y, s) >= 0.99 and (p == y).mean() >= 0.97


def test_normal_equations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random((90, quality.N_STATISTICS)).astype(np.float32)
    y = rng.integers(0, 2, 90)
    model = quality.QualityModel(x.mean(0).astype(float), x.std(0).astype(float), rng.standard_normal((quality.N_STATISTICS, 7)),
                                 rng.random(7), np.zeros(8), np.zeros(1), np.zeros(1))
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<float>, label int").repartition(5)
    f = model.features(x.astype(float))
    got = quality.normal_equations(df, model)
    assert np.allclose(got[:, :-1], f.T @ f) and np.allclose(got[:, -1], f.T @ y)
    assert (quality.normal_equations(df.limit(0), model) == 0).all()


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d, n = quality.N_STATISTICS, 6000
    model = quality.QualityModel(np.zeros(d), np.ones(d), rng.standard_normal((d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n),
                                 np.zeros(n + 1), np.zeros(1), np.zeros(1))
    x = rng.standard_normal((6, d))
    f = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(f @ f.T - want).max() < 0.08


@pytest.mark.parametrize("seed", range(5))
def test_pooling_is_the_closest_monotone_sequence(seed):
    rng = np.random.default_rng(seed)
    v, w = rng.random(9), rng.random(9) + 0.1
    got = quality.pool_adjacent(v, w)
    assert (np.diff(got) >= -1e-12).all()
    # max-min formula of isotonic regression
    want = [max(min(np.average(v[a:b + 1], weights=w[a:b + 1]) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
    assert np.allclose(got, want)


def test_odd_documents_and_labels(spark):
    docs = odd_documents(spark, ["x", "score", "ID", "label"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels, F.lit(True), n_features=8)
    assert out.columns == ["doc_id", "score"] and out.count() == docs.count()
    rows = out.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5, 6)}) == 1  # no words, one score
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert quality.quality_scores(no_documents(spark), labels, F.lit(True)).collect() == []


def plain_statistics(text):
    """The statistics by loops over words, lines and bytes."""
    raw = (text or "").encode()
    words, cur = [], b""
    for c in raw + b" ":
        if c in b" \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = b""
        else:
            cur += bytes([c])
    if not words:
        return [0.0] * quality.N_STATISTICS
    n, size = len(words), len(raw)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda low, high: sum(low <= c < high for c in raw) / size
    two = {(a, b) for a, b in zip(words, words[1:])}
    return [np.log(n + 1), np.log(size + 1), mean, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, np.log(max(lengths) + 1),
            len(set(words)) / n, (len(two) + 1) / n, np.log(n / len(lines) + 1), len(set(lines)) / len(lines),
            sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n, sum(x <= 2 for x in lengths) / n,
            sum(x >= 15 for x in lengths) / n, share(65, 91) + share(97, 123) + share(128, 256), share(65, 91), share(97, 123),
            share(48, 58), share(128, 256), share(0, 9) + share(14, 32), *[(raw.count(bytes([c])) / size) ** 0.5 for c in quality._MARKS]]


def test_statistics_by_loops(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*texts, None, "", " \n", "x", "A b\n\nÀ é \x01 42!", "#\t#\x0b#"]:
        assert np.allclose(quality.statistics(t), plain_statistics(t)), t and t[:50]


def test_the_whole_query_against_numpy(spark):
    """Every step by numpy over all rows: statistics, moments, kernel features, ridge, bins, isotonic map."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(4)) == 0
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.quality in (0, 1)}
    rows = docs.select("doc_id", "text", fold.alias("check")).collect()
    x = np.array([plain_statistics(r.text) for r in rows], np.float32).astype(float)
    has = np.array([r.doc_id in known for r in rows])
    check = np.array([r.check for r in rows])
    y = np.array([known.get(r.doc_id, 0) for r in rows], float)
    rng = np.random.default_rng(10)
    omega = rng.standard_normal((quality.N_STATISTICS, 256)) / np.sqrt(quality.N_STATISTICS)
    phase = rng.uniform(0, 2 * np.pi, 256)
    learn = has & ~check
    mean, scale = x[learn].mean(0), np.maximum(x[learn].std(0), 1e-6)
    f = np.cos(np.clip((x - mean) / scale, -5, 5) @ omega + phase) * np.sqrt(2 / 256)
    f = np.hstack([f, np.ones((len(f), 1))])
    a = f[learn].T @ f[learn]
    raw = f @ np.linalg.solve(a + 1e-3 * learn.sum() / len(a) * np.eye(len(a)), f[learn].T @ y[learn])
    held = has & check
    cell = np.floor(np.clip(raw[held], -0.5, 1.5) * 400)
    cells = np.unique(cell)
    n = np.array([(cell == c).sum() for c in cells], float)
    centre = np.array([raw[held][cell == c].mean() for c in cells])
    p = np.array([y[held][cell == c].mean() for c in cells])
    m = len(p)
    run_w, run_v = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
    level = np.array([max(min((run_v[b + 1] - run_v[s]) / (run_w[b + 1] - run_w[s]) for b in range(i, m)) for s in range(i + 1)) for i in range(m)])
    level = np.round(level, 12)
    steps = np.split(np.arange(m), np.flatnonzero(np.diff(level)) + 1)
    want = np.interp(raw, [np.average(centre[s], weights=n[s]) for s in steps], [level[s[0]] for s in steps])
    got = {r.doc_id: r.score for r in op10_quality_classifier(spark, sf).collect()}
    off = np.abs(np.array([got[r.doc_id] for r in rows]) - want)
    # a row next to a bin's edge may fall on its other side by rounding
    assert np.median(off) < 1e-6 and (off < 0.02).mean() > 0.99


def test_a_very_long_text(spark):
    long = " ".join(f"word{i % 1013}" for i in range(2_000_000))
    docs = spark.createDataFrame([(1, long), (2, "short text")], "doc_id long, text string")
    x = {r.id: r.x for r in quality.with_statistics(docs, "doc_id", "text").collect()}
    assert x[1][0] == pytest.approx(np.log(2_000_001), rel=1e-6) and x[1][5] == pytest.approx(1013 / 2_000_000, rel=1e-5)
