import random

import pytest
import xxhash
from pyspark.sql import functions as F

from textlens.llm import simhash
from textlens.llm.common import staged
from textlens.llm.components import connected_components
from textlens.llm.queries import op8_simhash

from .helpers import SF, ascii_lower, no_documents, odd_documents, words


def brute_print(text, n=3):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_groups(prints, bits=3):
    g = Groups()
    p = sorted(set(prints))
    for i, a in enumerate(p):
        g.find(a)
        for b in p[:i]:
            if (a ^ b).bit_count() <= bits:
                g.join(a, b)
    return g


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    g = brute_groups(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(g.find(p), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", least[g.find(p)]) for i, p in prints.items()}


@pytest.mark.parametrize("hot,bits", [(1024, 3), (2, 3), (0, 2), (1, 1), (2, 0)])
def test_links_of_crowded_and_empty_cells(spark, hot, bits):
    rnd = random.Random(hot + bits)
    points = [rnd.getrandbits(64) for _ in range(40)]
    for p in points[:12]:
        for _ in range(6):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                q ^= 1 << b
            points.append(q)
    points += [0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63)]
    df = spark.createDataFrame([(signed(p),) for p in set(points)], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, bits, hot).collect()]
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits for a, b in links)
    g, want = Groups(), brute_groups(points, bits)
    for a, b in links:
        g.join(a % (1 << 64), b % (1 << 64))
    assert {p: g.find(p) for p in points} == {p: want.find(p) for p in points}
    if hot == 1024:  # every link between different texts is listed
        p = sorted(set(points))
        assert len(set(map(frozenset, links))) == sum((a ^ b).bit_count() <= bits for i, a in enumerate(p) for b in p[:i])


@pytest.mark.parametrize("hot,joins", [(1024, 1), (0, 2)])
def test_exploded_rows_are_not_broadcast(spark, capsys, hot, joins):
    """34 grid rows and 65 ball rows of a fingerprint are estimated as its one."""
    points = staged(spark.range(3000).select(F.xxhash64("id").alias("fp")), "test-points")
    simhash.near_links(points, 3, hot).explain()
    plan = capsys.readouterr().out.splitlines()
    assert not [p for p in plan if "BroadcastHashJoin" in p and "Inner" in p]
    assert sum("SortMergeJoin" in p and "Inner" in p for p in plan) == joins


def test_bits_beyond_the_grid_are_refused(spark):
    with pytest.raises(ValueError, match="0 to 3"):
        simhash.near_links(spark.range(1).select(F.col("id").alias("fp")), 4)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [
        (500, 600 + i) for i in range(40)] + [(1, None), (5, 5)]
    g = Groups()
    for a, b in edges:
        if b is not None and a != b:
            g.join(a, b)
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.root for r in connected_components(df, "x", "y").collect()}
    assert got == {n: g.find(n) for n in list(g.up)}
    assert connected_components(df.limit(0), "x", "y").collect() == []


def test_odd_documents(spark):
    docs = odd_documents(spark, ["fp", "Fingerprint", "component", "id", "root"])
    rows = docs.collect()
    out = simhash.simhash_components(docs).collect()
    prints = [brute_print(r.text) for r in rows]
    g = brute_groups(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[g.find(p)] = min(r.doc_id, least.get(g.find(p), r.doc_id))
    want = sorted((r.doc_id is None, r.doc_id or 0, f"{p:016x}", least.get(g.find(p)) or 0) for r, p in zip(rows, prints))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in out) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(brute_print(r.text) for r in got) == sorted({min(q for q in prints if g.find(q) == g.find(p) and any(
        s.doc_id == least.get(g.find(p)) and brute_print(s.text) == q for s in rows)) for p in prints})
    assert {r.doc_id for r in got} == {least.get(g.find(p)) for p in prints}
    assert simhash.simhash_components(no_documents(spark)).collect() == [] and simhash.keep_one(no_documents(spark)).collect() == []


def test_very_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text, 3) == whole == brute_print(text)
