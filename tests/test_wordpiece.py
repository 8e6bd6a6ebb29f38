"""Sub-word ids by greedy longest match (P14): against loops over all prefixes, and back to the words."""

import random

import pytest

from textlens.functions import wordpiece as WP
from textlens.operators import scoring as S


def brute(word, vocab, unknown):
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        n = next((n for n in range(len(word) - at, 0, -1) if mark + word[at:at + n] in vocab and not word[at:].startswith("##")
                  and mark + word[at:at + n] != unknown), None)
        if n is None:
            return [vocab[unknown]]
        out.append(vocab[mark + word[at:at + n]])
        at += n
    return out


@pytest.mark.parametrize("seed", range(5))
def test_longest_matches_and_decoding(seed):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice("abcé中") for _ in range(rnd.randint(1, 4)))
    tokens = sorted({part() for _ in range(40)} | {f"##{part()}" for _ in range(40)})
    vocab = {"[PAD]": 0, "[UNK]": 1} | {t: i + 2 for i, t in enumerate(tokens)}
    name = {i: t for t, i in vocab.items()}
    words = ["".join(rnd.choice("abcé中") for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    ids = WP.word_pieces(vocab, special=("[PAD]",))()([w for w in words])
    assert ids == [brute(w, vocab, "[UNK]") for w in words]
    known = 0
    for w, mine in zip(words, ids):
        if mine != [1]:
            known += 1
            assert "".join(name[i].removeprefix("##") for i in mine) == w
    assert known > 20


def test_texts_cases_and_long_words(spark):
    vocab = {"[UNK]": 7, "un": 1, "##do": 2, "do": 3, "##[UNK]": 4, "x": 5, "##x": 6}
    run = WP.word_pieces(vocab)()
    assert run(["Undo do  UNDO", "", "doun [UNK]", "x" * 100, "x" * 101]) == [[1, 2, 3, 1, 2], [], [7, 7], [5] + [6] * 99, [7]]
    assert WP.word_pieces(vocab, lower=False)()(["Undo undo"]) == [[7, 1, 2]]
    df = spark.createDataFrame([(1, "undo do"), (2, None)], "k int, text string")
    out = {r.k: (r.input_ids, r.attention_mask) for r in S.encode_texts(df, WP.word_pieces(vocab), keep=["k"], max_length=4).collect()}
    assert out == {1: ([1, 2, 3, 0], [1, 1, 1, 0]), 2: ([0] * 4, [0] * 4)}


def test_the_vocabulary_is_bounded(spark, monkeypatch):
    entries = spark.createDataFrame([("a", 3), ("a", 2), (None, 1), ("b", 5)], "token string, id long")
    assert WP.vocabulary(entries) == {"a": 2, "b": 5}
    monkeypatch.setattr(WP, "MAX_ENTRIES", 1)
    with pytest.raises(ValueError):
        WP.vocabulary(entries)
