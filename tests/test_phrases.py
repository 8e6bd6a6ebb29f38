"""Leftmost-longest dictionary matches (J04): automaton and join against loops, and against the small dictionary's pattern."""

import random

import pytest
from pyspark.sql import functions as F

from textlens.operators import knowledge as K
from textlens.operators import phrases as PH


def brute(text, keys, single=False):
    if text is None:
        return None, 0
    longest = max(map(len, keys), default=0)
    out, at, seen = "", 0, set()
    while at < len(text):
        k = next((text[at:at + n] for n in range(min(longest, len(text) - at), 0, -1) if text[at:at + n] in keys), None)
        if k is None:
            out, at = out + text[at], at + 1
        else:
            out, at = f"{out} {keys[k]} ", at + len(k)
            if not single or len(k) == 1:
                seen.add(k)
    return out, len(seen)


WAYS = {"automaton": {}, "too many keys": {"max_keys": 0}, "too many bytes": {"max_bytes": 0}}


def got(df, d, way, **options):
    return sorted(((r.doc_id, r.expanded, r.n_keys) for r in PH.expand_phrases(df, d, **WAYS[way], **options).collect()), key=repr)


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("seed", range(2))
def test_both_ways_equal_loops(spark, way, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("ab é中\U0001f525️") for _ in range(rnd.randint(0, n)))
    pairs = [(word(6), rnd.choice(["x", "long meaning", "", None])) for _ in range(60)] + [(None, "n"), ("ab", "2"), ("ab", "1"), ("", "e")]
    keys = {}
    for k, v in pairs:
        if k and v is not None:
            keys[k] = min(v, keys.get(k, v))
    texts = [(i // 2, word(30) if i % 9 else None) for i in range(80)] + [(1, ""), (None, "ab ab"), (5, "ab"), (5, "ab")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_at", F.lit(1))
    d = spark.createDataFrame(pairs, "key string, value string")
    for single in (False, True):
        assert got(df, d, way, single=single) == sorted(((i, *brute(t, keys, single)) for i, t in texts), key=repr)
    assert got(df.limit(3), d.limit(0), way) == sorted(((r.doc_id, r.text, 0) for r in df.limit(3).collect()), key=repr)


def test_a_hundred_thousand_keys(spark):
    rnd = random.Random(1)
    keys = {"".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 9))): f"m{i}" for i in range(260_000)}
    assert len(keys) > 100_000
    texts = [(i, "".join(rnd.choice("abcdefg") for _ in range(300))) for i in range(60)]
    d = spark.createDataFrame(list(keys.items()), "key string, value string")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(((i, *brute(t, keys)) for i, t in texts), key=repr)
    assert got(df, d, "automaton") == want and got(df, d, "too many keys") == want


def test_large_emoji_tables_give_what_small_ones_give(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Hi \U0001f602 ❤️ lol ❤"), (2, None), (3, "none"), (4, "\U0001f602\U0001f602")], "doc_id long, text string")
    emoji = K.default_emoji(spark)
    small = [sorted(map(tuple, K.emoji_expand(df, emoji, count=c).collect()), key=repr) for c in ("codepoint", "sequence")]
    text = sorted(map(tuple, K.preprocess_text(df, dict(K.SLANG), emoji).collect()), key=repr)
    monkeypatch.setattr(K, "PATTERN_MAX_KEYS", 2)
    assert [sorted(map(tuple, K.emoji_expand(df, emoji, count=c).collect()), key=repr) for c in ("codepoint", "sequence")] == small
    assert sorted(map(tuple, K.preprocess_text(df, dict(K.SLANG), emoji).collect()), key=repr) == text
    with pytest.raises(ValueError):
        K.emoji_rows(emoji)


def test_without_the_library_texts_and_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(PH, "_automaton", lambda: None)
    df = spark.createDataFrame([(1, "abcab")], "doc_id long, text string")
    d = spark.createDataFrame([("ab", "1"), ("abc", "2")], "key string, value string")
    assert got(df, d, "automaton") == [(1, " 2  1 ", 2)]
