import hashlib
import random

import numpy as np
import pytest

from textlens.llm import induced, suffixes
from textlens.llm.queries import op11_suffix_dedup

from .helpers import ODD, SF, no_documents, odd_documents

COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
KIND = "doc_id long, text string"


def brute(docs, window=50):
    """Rows by a dictionary of all strings."""
    least, out = {}, []
    docs = [(i, (t or "").encode()) for i, t in docs]
    rank = lambda i: (i is not None, i or 0)
    for i, b in docs:
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            least[w] = min(least.get(w, rank(i)), rank(i))
    for i, b in docs:
        gone = [False] * len(b)
        reach = 0
        for p in range(len(b) - window + 1):
            if least[b[p:p + window]] < rank(i):
                gone[max(p, reach):p + window] = [True] * (p + window - max(p, reach))
                reach = p + window
        spans = [p for p, x in enumerate(gone) if x and not (p and gone[p - 1])]
        kept = bytes(c for c, x in zip(b, gone) if not x)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    assert rows_of(op11_suffix_dedup(spark, SF)) == want and sum(w[2] for w in want) > 10_000


def odd_texts(seed):
    """Texts of shared stretches around the limit, periodic ones, and one short line between ever different words."""
    rnd = random.Random(seed)
    stretches = ["".join(rnd.choice("ab \nñ中") for _ in range(rnd.choice([20, 40, 49, 50, 51, 60, 200]))) for _ in range(12)]
    line = "x" * 7 + " one line of forty characters it is. "
    texts = []
    for i in range(70):
        t = "".join(rnd.choice([rnd.choice(stretches), "".join(rnd.choice("cdefg") for _ in range(rnd.randint(0, 60))), line]) for _ in range(rnd.randint(0, 6)))
        texts.append((rnd.choice([i, i // 2, None]), t))
    return texts + [(300, "ab" * 900), (301, "ab" * 700 + "c"), (302, "z" * 1500), (303, "z" * 49), (304, "z" * 50), (305, "\0" * 60 + "\1" * 60), (306, "\0" * 55)]


@pytest.mark.parametrize("options", [
    {}, {"hot_key": 2, "chunk_bytes": 500}, {"hot_key": 0, "chunk_bytes": 3000, "gram": 8}, {"chunk_bytes": 1, "part_bytes": 200, "shard_bytes": 200},
    {"batch_bytes": 1, "gram": 30}, {"window": 20, "gram": 7, "chunk_bytes": 2000, "hot_key": 5}])
def test_limits_change_the_plan_only(spark, options):
    texts = odd_texts(len(options))
    df = spark.createDataFrame(texts, KIND).repartition(3)
    assert rows_of(suffixes.repeated_bytes(df, **options)) == brute(texts, options.get("window", 50))


def test_odd_documents(spark):
    docs = odd_documents(spark, ["chunk", "N_Bytes", "kept", "row", "id", "part"])
    out = suffixes.repeated_bytes(docs).collect()
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in out), key=repr)
    # repeated rows share an id, so neither removes from the other
    assert got == brute([(i, t) for i, t, _, _ in ODD])
    for r in out:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s.end - s.start for s in r.spans) == r.n_removed
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans
    assert suffixes.repeated_bytes(no_documents(spark)).collect() == []


def test_spans_keep_their_places(spark):
    passage = "this passage has rather more than fifty bytes in it, so it goes"
    rows = [(1, f"first {passage} end"), (2, f"{passage}!{passage}"), (3, f"über {passage}"), (4, passage[:49])]
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept).decode()) for r in suffixes.repeated_bytes(spark.createDataFrame(rows, KIND)).collect()}
    n = len(passage)
    assert got == {1: ([], rows[0][1]), 2: ([(0, n), (n + 1, 2 * n + 1)], "!"), 3: ([(5, 6 + n)], "über"), 4: ([], passage[:49])}


def test_a_very_long_text_and_many_copies(spark):
    rnd = random.Random(3)
    long = " ".join(f"{rnd.getrandbits(40):x}" for _ in range(400_000))
    cut = long[2_000_000:2_000_300]
    rows = [(1, "a" + cut + "b"), (2, long)] + [(k, "one and the same text of more than fifty bytes, many times") for k in range(3, 600)]
    got = {r.doc_id: r for r in suffixes.repeated_bytes(spark.createDataFrame(rows, KIND), with_text=False).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[1].n_removed, got[3].n_removed) == (300, 1, 0, 0)
    assert {got[k].n_removed for k in range(4, 600)} == {got[3].n_bytes}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        x = [rnd.randint(1, rnd.choice([1, 2, 3, 9, 40_000])) for _ in range(rnd.choice([0, 1, 5, 60, 300]))]
        if rnd.random() < 0.3:
            x = x[:7] * 20
        t = np.array([*x, 0], np.int32)
        array = induced.suffix_array(t).tolist()
        assert array == sorted(range(len(t)), key=lambda i: [*x[i:], 0])


def test_common_prefixes():
    text = b"banana bandana" * 3
    t = np.array([c + 2 for c in text] + [0], np.uint16)
    t[20] = 1
    array = induced.suffix_array(t)
    got = induced.common_prefixes(t, array, np.array([0, 21]), np.array([20, 42]), 9)
    for before, here in zip(array[:-1], array[1:]):
        n = 0
        while n < 9 and t[before + n] == t[here + n] and t[here + n] > 1:
            n += 1
        assert got[here] == (n if here not in (20, 42) else 0)
