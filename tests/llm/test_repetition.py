import inspect
import os

import numpy as np
import pytest

from textlens.llm import repetition
from textlens.llm.queries import op3_repetition_rules

from .helpers import SF, no_documents, odd_documents, words


def brute_longest(w):
    n = len(w)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def brute_row(text, min_repeat=10, max_covered=0.3, max_longest=50):
    text = text or ""
    w = words(text)
    n = len(w)
    windows = {}
    for i in range(n - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    longest = brute_longest(w) if n < 160 else None
    base = (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again),
            n < 50 or 100 * len(again) > 50 * n)
    if longest is None:
        return base, None
    cover = {j for i, k in enumerate(longest) if k >= min_repeat for j in range(i, i + k)}
    kept = not base[-1] and len(cover) <= max_covered * n and max(longest, default=0) <= max_longest
    return base, (kept, len(cover), max(longest, default=0))


def check(rows, texts):
    for r, text in zip(rows, texts):
        base, rest = brute_row(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        if rest is not None:
            assert (r.kept, r.covered_words, r.longest_repeat) == rest
        if "spans" in r:
            assert sum(s.end - s.start for s in r.spans) == r.covered_words


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op3_repetition_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, [texts[r.doc_id] for r in rows])


def test_rejects_what_repeats_long(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    part = " ".join(f"p{i}" for i in range(60))
    rows = [(1, clean), (2, f"{clean} {part} x {part}"), (3, " ".join(["q r s t u v w x y z a b " + f"n{i}" * 1 for i in range(20)])),
            (4, f"{part} {part}")]
    out = {r.doc_id: r for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(out.values(), [dict(rows)[i] for i in out])
    assert out[1].kept and not any(out[i].kept for i in (2, 3, 4))
    assert out[2].longest_repeat == 60 and [tuple(s) for s in out[2].spans] == [(200, 260), (261, 321)]


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [list(rng.integers(0, rng.integers(1, 6), rng.integers(0, 60))) for _ in range(12)] + [[0] * 70, [], [1]]
    texts += [texts[0], texts[0]]  # copies are other texts
    flat = np.array([x for t in texts for x in t], np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = repetition.longest_repeats(flat, of)
    assert got.tolist() == [x for t in texts for x in brute_longest(t)]


def test_odd_documents(spark):
    docs = odd_documents(spark, ["n_words", "kept", "id"])
    rows = repetition.repetition_rules(docs).collect()
    texts = [r.text for r in docs.collect()]
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    check([by[r.doc_id] for r in docs.collect() if r.doc_id is not None], [r.text for r in docs.collect() if r.doc_id is not None])
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[7].longest_repeat == 2999
    assert repetition.repetition_rules(no_documents(spark)).collect() == []


def test_chunks_do_not_change_the_answer(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(str, repetition.repetition_rules(docs).collect()))
    monkeypatch.setattr(repetition, "_CHUNK_WORDS", 700)
    assert sorted(map(str, repetition.repetition_rules(docs).collect())) == whole


def test_readme_states_the_limits():
    with open(os.path.join(os.path.dirname(__file__), "..", "..", "README.md")) as f:
        readme = f.read()
    limits = inspect.signature(repetition.repetition_rules).parameters
    for name in ("min_repeat", "max_covered", "max_longest"):
        assert f"`{name}={limits[name].default}`" in readme, name


def test_a_very_long_text(spark):
    import random

    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(1_000_000)]
    passage = " ".join(words[500_000:500_080])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + " " + passage)], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert (got[1].n_words, got[1].kept) == (1_000_000, True)
    assert (got[2].n_words, got[2].kept) == (1_000_080, False)  # a repeat of 80 words is over the longest allowed
