import math
import zlib

import numpy as np

from textlens.llm import toxicity
from textlens.llm.queries import op4_toxicity

from .helpers import connection, no_documents, odd_documents

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    con = connection(SF)
    truth = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = op4_toxicity(spark, SF).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    caught = np.mean([p for p, _, y in held if y == 1])
    blamed = np.mean([p for p, _, y in held if y == 0])
    assert caught >= 0.8 and blamed <= 0.02


def brute(model, text):
    """The noisy-or by its formula, sentence by sentence."""
    clean = 1.0
    for m in toxicity._SENTENCE.finditer(text):
        z = model.bias + sum(model.weights.get(f, 0.0) for w in set(toxicity._WORD.findall(m[0].lower())) for f in toxicity.features(w))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_documents_teach_sentences(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice(vocabulary, 8)) for _ in range(rng.integers(1, 12))]
        toxic = i % 2
        if toxic:
            k = rng.integers(len(s))
            s[k] += rng.choice([" vile", " vileness today", " rotten"])
        texts.append(". ".join(s) + ".")
        labels.append(toxic)
    model = toxicity.fit(texts[:300], labels[:300])
    score = model.scorer()
    for text, y in zip(texts[300:], labels[300:]):
        p, n, found = score(text)
        assert abs(p - brute(model, text)) < 1e-9 and n == text.count(".") and (p >= 0.5) == bool(y)
        assert all(("vile" in text[a:b]) or ("rotten" in text[a:b]) for a, b, _ in found) and bool(found) == bool(y)


def test_one_kind_of_label_or_none():
    assert toxicity.fit([], []).scorer()("a b")[0] == 0.0
    assert toxicity.fit(["a", "b"], [1, 1]).scorer()("")[0] == 1.0
    assert toxicity.fit(["a", "b"], [0, 0]).scorer()("x")[0] == 0.0


def test_odd_documents_and_labels(spark):
    docs = odd_documents(spark, ["score", "Offending", "id", "label"])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (7, None), (99, 1), (8, 5)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    out = toxicity.score_documents(docs, model, carry=("lang", "score", "label"))
    assert out.columns == ["lang", "label", "doc_id", "score", "n_sentences", "offending"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    real = toxicity.NoisyOr(-3.0, {"alpha": 6.0})
    by = {r.doc_id: r for r in toxicity.score_documents(docs, real).collect()}
    assert by[3].score == by[4].score == 0.0 and by[3].offending == [] and by[3].n_sentences == 0
    text = "Alpha beta gamma delta. Alpha beta gamma delta."
    assert [text[s.start:s.end].strip() for s in by[2].offending] == ["Alpha beta gamma delta."] * 2
    assert toxicity.score_documents(no_documents(spark), real).collect() == []
    assert toxicity.fit_on(no_documents(spark), labels).prior == 0.0


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    rows = [(1, "b vile.")] * 500 + [(1, "a vile.")] * 20 + [(1, "x" * 50), (2, "clean."), (3, "other."), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: given.extend(zip(texts, labels)))
    toxicity.fit_on(docs, labels, max_chars=20)
    assert given == [("a vile.", 1), ("clean.", 0), ("other.", 0)]


def test_the_fit_is_where_the_likelihood_is_flat():
    """Numeric differences of the documents' log-likelihood, computed sentence by sentence, vanish at the fitted weights."""
    rng = np.random.default_rng(5)
    texts = [". ".join(" ".join(rng.choice(["a", "b", "c", "vile", "rot"], 3, p=[0.3, 0.3, 0.3, 0.06, 0.04])) for _ in range(rng.integers(1, 5))) for _ in range(300)]
    labels = [int(("vile" in t or "rot" in t) ^ (rng.random() < 0.1)) for t in texts]
    l2 = 1e-3
    model = toxicity.fit(texts, labels, min_docs=3, l2=l2, steps=6000, rate=0.01)
    names = sorted(model.weights)
    assert {"vile", "vil*", "rot"} <= set(names)

    def loss(theta):
        m = toxicity.NoisyOr(theta[-1], dict(zip(names, theta)))
        total = 0.0
        for t, y in zip(texts, labels):
            p = min(max(brute(m, t), 1e-12), 1 - 1e-12)
            total -= math.log(p if y else 1 - p)
        return total / len(texts) + l2 / 2 * sum(w * w for w in theta[:-1])

    theta = [*[model.weights[n] for n in names], model.bias]
    for i in range(len(theta)):
        up, down = list(theta), list(theta)
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs(loss(up) - loss(down)) / 2e-4 < 2e-3
