import hashlib
import random

import pytest

from textlens.llm import bpe
from textlens.llm.queries import op1_byte_bpe, tokenizer

from .helpers import ODD, SF, no_documents, odd_documents


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(*tokenizer())


def expected(enc, text):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, enc):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(enc, texts[r.doc_id])


def test_odd_documents(spark, enc):
    out = bpe.encode_documents(odd_documents(spark, ["ids", "N_Tokens", "id"]), *tokenizer()).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    assert got == sorted((i is None, i or 0, *expected(enc, t)) for i, t, _, _ in ODD)
    for r in out:
        assert len(r.ids) == r.n_tokens and hashlib.sha256(bpe.decode(enc, r.ids)).hexdigest() == r.decoded_sha256
    assert bpe.encode_documents(no_documents(spark), *tokenizer()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_pieces_give_the_ids_of_the_whole(enc, seed):
    rnd = random.Random(seed)
    alphabet = ["a", "B", "é", "中", "1", "'s", "'", "!", " ", "  ", "\n", "\t", " ", " ", "　", "the ", " don't", "\U0001f525", "\x1c"]
    text = "".join(rnd.choice(alphabet) * rnd.choice([1, 1, 1, 2, 5]) for _ in range(9000))
    assert bpe.encode(enc, text, size=rnd.choice([7, 50, 1000])) == enc.encode_ordinary(text)
    assert "".join(bpe.pieces(text, 11)) == text


@pytest.mark.parametrize("tail", ["", "x", " x", "\nx"])
def test_white_space_runs(enc, tail):
    text = "start" + " \n" * 15_000 + tail
    assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_a_run_beyond_the_engine_is_encoded(enc):
    text = "a" + " " * 2_000_000 + "b"
    ids = bpe.encode(enc, text)
    assert bpe.decode(enc, ids).decode() == text


def test_decoding_is_of_raw_bytes(enc):
    ids = enc.encode_ordinary("\U0001f525")
    cut = [bpe.decode(enc, [i]) for i in ids]
    assert len(ids) > 1 and b"".join(cut) == "\U0001f525".encode()
