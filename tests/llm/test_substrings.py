import random
import re

import numpy as np

from textlens.llm import substrings
from textlens.llm.queries import op2_substring_dedup, sentence_dedup

from .helpers import SF, ascii_lower, no_documents, odd_documents, same_as_sql


def brute(rows, unit="sentence", min_words=20):
    """[(id, start, end)] by plain loops; rows equal in id and text are one document."""
    seen, docs = {}, sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, t in docs:
        run = None
        for k, m in enumerate(re.finditer(substrings.UNITS[unit], t)):
            key = tuple(re.findall(r"[^\x20\x09-\x0D.!?]+", ascii_lower(m[0])))
            if key in seen:
                if run is None:
                    run = [m.start(), m.end(), 0]
                run[1], run[2] = m.end(), run[2] + len(key)
            else:
                seen[key] = (i, k)
                if run and run[2] >= min_words:
                    out.append((i, run[0], run[1]))
                run = None
        if run and run[2] >= min_words:
            out.append((i, run[0], run[1]))
    return out


def test_sentences_match_sql(spark):
    same_as_sql(sentence_dedup(spark, SF), substrings.ORACLE)


def test_units_cover_the_text():
    text = "One. two!\n\nthree\nfour? \n \nfive"
    for unit, pattern in substrings.UNITS.items():
        assert "".join(m[0] for m in re.finditer(pattern, text)) == text, unit


def test_brute_force_and_cleaned_texts(spark):
    passage = "This is the shared passage. It has many short parts. Yes. No. And it goes on for a while until it is done."
    rows = [(5, f"Before it {passage} after five."), (2, f"Other start. {passage} Other end"), (9, passage), (9, passage),
            (3, "Yes. No."), (7, passage.upper()), (8, "Plain text."), (4, None), (None, passage), (6, "\n" + passage + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in substrings.UNITS:
        spans = substrings.repeated_spans(df, unit=unit, min_words=8)
        got = sorted((r.doc_id, r.start, r.end) for r in spans.collect())
        assert got == sorted(brute(rows, unit, 8)), unit
    spans = substrings.repeated_spans(df, min_words=8)
    clean = {(r.doc_id, r.text) for r in substrings.remove_spans(df.withColumn("Start", df.doc_id), spans).drop("Start").collect()}
    cuts = {}
    for i, a, b in brute(rows, "sentence", 8):
        cuts.setdefault(i, []).append((a, b))
    for i, t in rows:
        for a, b in sorted(cuts.get(i, []), reverse=True):
            t = t[:a] + t[b:]
        assert (i, t) in clean
    assert all(r.first_doc_id is None for r in spans.where("doc_id in (7, 9)").collect())


def test_odd_documents(spark):
    docs = odd_documents(spark, ["start", "unit", "H1", "id", "first"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.start, r.end) for r in substrings.repeated_spans(docs, min_words=4).collect())
    assert got == sorted(brute(rows, min_words=4)) and got
    spans = substrings.repeated_spans(docs, min_words=4)
    assert substrings.remove_spans(docs, spans).columns == docs.columns
    assert substrings.remove_spans(docs, spans).count() == docs.count()
    assert substrings.repeated_spans(no_documents(spark)).collect() == []


def key_words(text):
    """Words of a text without sentence ends, A-Z lower-cased, and where they begin."""
    found = list(re.finditer(r"[^\x20\x09-\x0D.!?]+", text))
    return [ascii_lower(m[0]) for m in found], [m.start() for m in found]


def repeated(rows, n):
    """{(id, text): for each word, whether it lies in a window of n words that stands earlier too}, by plain loops."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, _ = key_words(t)
        out[i, t] = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if (key := tuple(w[k:k + n])) in seen:
                out[i, t][k:k + n] = True
            seen.add(key)
    return out


def against_windows(rows, spans, min_words=20):
    """Words removed without a repeat; stretches of 50 repeated words, those not met, and most words left of one."""
    gone = {}
    for r in spans:
        gone.setdefault(r.doc_id, []).append((r.start, r.end))
    short, long = repeated(rows, min_words), repeated(rows, 50)
    wrong = stretches = missed = left = 0
    for (i, t), again in long.items():
        _, at = key_words(t)
        cut = np.zeros(len(at), bool)
        for a, b in gone.get(i, []):
            cut[np.searchsorted(at, a):np.searchsorted(at, b)] = True
        wrong += int((cut & ~short[i, t]).sum())
        edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        for a, b in edge.reshape(-1, 2):
            stretches += 1
            missed += not cut[a:b].any()
            left = max(left, int((~cut[a:b]).sum()))
    return wrong, stretches, missed, left


def pasted(seed=3):
    """Texts with passages of 50 to 120 words in mid-sentence, of sentences of any length."""
    rng = random.Random(seed)
    def prose(n, end):
        return " ".join(f"w{rng.randrange(4000)}" + ("." if rng.random() < end else "") for _ in range(n))
    passages = [prose(rng.randrange(50, 120), end) for end in (0, 0.02, 0.1, 0.4) for _ in range(5)]
    return [(i, f"{prose(rng.randrange(60), 0.1)} {rng.choice(['é', 'x'])} {passages[i % 20]} {prose(rng.randrange(60), 0.1)}".strip())
            for i in range(80)]


def test_passages_against_repeated_windows(spark):
    rows = pasted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wrong, stretches, missed, left = against_windows(rows, substrings.repeated_passages(df).collect())
    assert (wrong, missed) == (0, 0) and stretches >= 60 and left <= 3 * substrings.BORDER_WINDOW - 1
    # whole sentences miss some
    assert against_windows(rows, substrings.repeated_spans(df).collect())[2] > 0


def test_passages_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    spans = op2_substring_dedup(spark, SF).collect()
    wrong, stretches, missed, _ = against_windows(rows, spans)
    assert (wrong, missed) == (0, 0) and stretches
    assert len(spans) == len({(r.doc_id, r.start) for r in spans})


def test_passages_of_odd_documents(spark):
    docs = odd_documents(spark, ["start", "word", "H1", "id", "first"])
    spans = substrings.repeated_passages(docs, min_words=8)
    by = {(r.doc_id, r.start, r.end) for r in spans.collect()}
    assert {(2, 0, 47), (7, 95, 15000)} == by  # 11 words to the first border and the 8 after it stay
    assert substrings.remove_spans(docs, spans).columns == docs.columns
    assert substrings.remove_spans(docs, spans).count() == docs.count()
    assert substrings.repeated_passages(no_documents(spark)).collect() == []


def plain_passages(rows, min_words=20):
    """The query by loops: [(id, start, end)] of the union of all later stretches; the borders are cut_passages' own."""
    seen, out = {}, []
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0)):
        _, first, last, word, word_end, keys = substrings.cut_passages([t.encode()], min_words)
        later = []
        for a, b, w, v, k in sorted(zip(first, last, word, word_end, keys, strict=True)):
            if k not in seen:
                seen[k] = (i, t, b, v)
                continue
            j, u, e, f = seen[k]
            if (j, u) == (i, t):
                a, w = max(a, e), max(w, f)
            if w < v:
                later.append((a, b, w, v))
        spans = []
        for a, b, w, v in sorted(later):
            if spans and a <= spans[-1][1]:
                s = spans[-1]
                spans[-1] = (s[0], max(s[1], b), min(s[2], w), max(s[3], v))
            else:
                spans.append((a, b, w, v))
        points = lambda k: len(t.encode()[:k].decode())
        out += [(i, points(a), points(b)) for a, b, w, v in spans if v - w >= min_words]
    return sorted(out)


def test_the_whole_query_against_loops(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.end) for r in op2_substring_dedup(spark, SF).collect())
    assert got == plain_passages(rows) and len(got) > 50
    rows = pasted(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.end) for r in substrings.repeated_passages(df).collect()) == plain_passages(rows)


def test_one_document_repeated_ten_thousand_times(spark):
    rows = pasted(5)[:30]
    many = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        spark.range(10_000).selectExpr("7L AS doc_id").crossJoin(spark.createDataFrame([(rows[7][1],)], "text string")))
    for find in (substrings.repeated_passages, substrings.repeated_spans):
        once = find(spark.createDataFrame(rows, "doc_id long, text string"))
        df = find(many)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, once.collect())) != []
        # below the exchange that brings a document together its rows are combined
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan
        lines = find(many)._jdf.queryExecution().executedPlan().toString().split("\n")
        sent = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(id" in x]
        assert len(sent) == 1 and "partial_collect_set" in lines[sent[0] + 1]


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(2_000_000))
    words = long.split(" ")
    rows = [(1, "a b c " + " ".join(words[1_000_000:1_000_100]) + " d e"), (2, long), (3, long)]
    spans = sorted((r.doc_id, r.n_words) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [i for i, _ in spans] == [2, 3] and 70 <= spans[0][1] <= 100 and spans[1][1] == 2_000_000
