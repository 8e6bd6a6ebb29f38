from textlens.llm import line_dedup
from textlens.llm.queries import op7_line_dedup

from .helpers import SF, WS, ascii_lower, no_documents, odd_documents, same_as_sql


def brute(rows, min_chars, min_docs):
    """{(id, text): (kept text, lines, dropped)}"""
    split = [(i, t or "", (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, _, lines in split:
        for x in lines:
            key = ascii_lower(x.strip(WS))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    keep = {k: max((i for i in d if i is not None), default=None) for k, d in holders.items() if len(d) >= min_docs}
    out = {}
    for i, t, lines in split:
        left = [x for x in lines if (k := ascii_lower(x.strip(WS))) not in keep or keep[k] == i]
        out[i, t] = ("\n".join(left), len(lines), len(lines) - len(left))
    return out


def test_matches_sql(spark):
    same_as_sql(op7_line_dedup(spark, SF), line_dedup.ORACLE)


def test_brute_force(spark):
    line = "This Line Stands In Many Documents, Étude"
    rows = [(i, f"own {i}\n {line.upper()}\t\nend") for i in range(4)] + [
        (9, f"{line}\n{line}\nx"), (9, f"other text\n{line}"), (None, f"{line}\nnull"), (None, line), (12, "\n\n"), (13, None),
        (14, f"{line.replace('É', 'é')}"), (15, "short\nshort"), (16, f"{line}\nlast {line}"), (16, f"{line}\nlast {line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(df, min_chars=10, min_docs=3).collect()
    want = brute(rows, 10, 3)
    assert len(out) == len(rows)
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in out)
    assert texts == sorted((i is None, i or 0, *want[i, t or ""]) for i, t in rows)
    assert any(r.n_dropped for r in out)


def test_odd_documents(spark):
    docs = odd_documents(spark, ["N_LINES", "_llm_pos", "hash"])
    out = line_dedup.dedup_lines(docs, min_chars=4, min_docs=2)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_llm_pos", "hash", "n_lines", "n_dropped"]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 2)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *want[r.doc_id, r.text or ""]) for r in docs.collect())
    assert line_dedup.dedup_lines(no_documents(spark)).collect() == []


def test_a_very_long_text(spark):
    shared = "this line of the licence stands in many documents of the corpus"
    long = "\n".join(f"line {i} of a text of some millions of words, " + "word " * 20 for i in range(100_000))
    rows = [(i, f"text {i}\n{shared}") for i in range(1, 6)] + [(6, long + "\n" + shared), (0, shared + "\n" + long)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[0].n_lines, out[0].n_dropped, out[0].text) == (100_001, 1, long)
    assert (out[6].n_lines, out[6].n_dropped, out[6].text) == (100_001, 0, long + "\n" + shared) and out[3].text == "text 3"
