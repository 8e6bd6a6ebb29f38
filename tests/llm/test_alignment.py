import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textlens.llm import alignment
from textlens.llm.queries import op13_align_tokenizers

from .helpers import ODD, SF, no_documents, odd_documents

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
BOXES = ["a", "Bc", "é", "中", "1", "23", "'s", "'", "!", " ", "  ", "\n", "\t", "\xa0", "　", "the ", " don't", "\U0001f525",
         "\x1c", "</s>", "<s>", "<0x41>", "<|endoftext|>", "-----", "ﬁ", "é", " \n ", "\x00"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=FILES[1])


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(*FILES)


def ids_of(plain, tok, text):
    """Ids of the whole text by the two libraries; none if the bytes differ."""
    if not text:
        return [], []
    a = plain[0].encode(" " + text, add_special_tokens=False).ids
    b = plain[1].encode(text)
    whole = (" " + text).encode()
    same = b"".join(tok.a_bytes[i] for i in a) == whole == b"".join(tok.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def brute(plain, tok, texts):
    """Spans, groups and links by loops over the offsets."""
    links, out = [], []
    for text in texts:
        a, b = ids_of(plain, tok, text)
        spans = []
        for ids, table in ((a, tok.a_bytes), (b, tok.b_bytes)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(mine)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans))
            low = high
        met, j = [], 0
        for s, e, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                met.append((i, spans[1][k][2]))
                k += 1
        links.append(met)
        out.append((len(a), len(b), len(groups), ";".join(groups)))
    held = Counter(p for met in links for p in set(met))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    rows = []
    for (n_a, n_b, n_groups, text), met in zip(out, links):
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        rows.append((n_a, n_b, n_groups, len(met), sum(held[p] == best[p[0]] for p in met), sum(held[p] for p in met), sha, text))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_whole_table(spark, plain, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, brute(plain, tok, texts.values())))
    got = op13_align_tokenizers(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id][:-1]


@pytest.mark.parametrize("chunk_bytes", [1, 16 << 20])
def test_odd_documents(spark, plain, tok, chunk_bytes):
    out = alignment.align_tokens(odd_documents(spark, ["n_a", "Pairs", "chunk", "id"]), *FILES, chunk_bytes=chunk_bytes)
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLUMNS), r.groups) for r in out.collect())
    want = brute(plain, tok, [t for _, t, _, _ in ODD])
    assert got == sorted((i is None, i or 0, *w) for (i, *_), w in zip(ODD, want))
    assert alignment.align_tokens(no_documents(spark), *FILES).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_parts_give_the_ids_of_the_whole(plain, tok, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(BOXES) * rnd.choice([1, 1, 1, 2, 5]) for _ in range(rnd.choice([3, 40, 400]))) for _ in range(30)]
    texts += ["▁", "a ▁ b", "a▁b c", " ", "\n", "", "x", " lead", "trail ", "end.\nStart of"]
    parts = alignment.Parts(tok)
    got = parts.align(texts, True)
    want = brute(plain, tok, texts)
    for i, w in enumerate(want):
        assert (*(int(got[c][i]) for c in COLUMNS[:4]), got["groups"][i]) == (*w[:4], w[-1]), repr(texts[i])
    assert parts.align(texts, True)["groups"] == got["groups"]  # all parts known by now


def test_every_code_point_is_encoded_alike(plain, tok):
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in [*range(1, 0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10400), *range(0x1F000, 0x1FB00)]
             if not 0xD800 <= c < 0xE000]
    for t, e in zip(texts, plain[0].encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert tok.a.encode_ordinary(" " + t) == e.ids, repr(t)


def test_a_very_long_text_and_many_copies(spark, plain, tok):
    long = " ".join(f"word{i % 977} über{i % 31}." for i in range(300_000)) + "x" * 20_000
    rows = [(1, long)] + [(k, "the very same text, again and again") for k in range(2, 400)]
    got = {r.doc_id: r for r in alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()}
    a, b = ids_of(plain, tok, long)
    assert (got[1].n_a, got[1].n_b) == (len(a), len(b)) and len(a) > 1_000_000
    assert {tuple(got[k])[1:] for k in range(2, 400)} == {tuple(got[2])[1:]} and got[2].count_sum >= 398 * got[2].n_links


def test_pointers_reach_the_end_of_long_chains():
    import numpy as np

    a = np.array([*range(2, 2001, 2), 2001])  # ends in turn, met by B at the last one only
    b = np.array([*range(1, 2000, 2), 2001])
    group_a, group_b = alignment.components(a, b)
    assert set(group_a) == {0} and set(group_b) == {0}
    assert [x.tolist() for x in alignment.components(np.array([], int), np.array([], int))] == [[], []]
