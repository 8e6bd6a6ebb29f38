"""Sub-word ids by greedy longest match over a given vocabulary.

A word's first piece is the longest entry that begins it; each further piece is
the longest entry, written with ``##``, that begins what is left.  A word with a
part that no entry begins is unknown as a whole.  The vocabulary is an
input, one entry per line of a file or row of a table; nothing is learnt here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary is shipped with every task, so its size is checked.
MAX_ENTRIES = 1_000_000
MAX_WORD = 100  # longer words are unknown, as is usual for such vocabularies
_MEMO = 200_000


def vocabulary(entries: DataFrame, token_col: str = "token", id_col: str = "id") -> dict[str, int]:
    """Token -> id from a table of at most ``MAX_ENTRIES`` rows; of a token listed twice the smallest id counts."""
    rows = (entries.where(F.col(token_col).isNotNull()).groupBy(token_col).agg(F.min(id_col).alias("_id"))
            .limit(MAX_ENTRIES + 1).collect())
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a vocabulary has at most {MAX_ENTRIES} entries")
    return {r[token_col]: int(r["_id"]) for r in rows}


def _trie(entries: Mapping[str, int]) -> dict:
    """Nested dictionaries by character; the key '' holds the id of the entry that ends there."""
    root: dict = {}
    for token, number in entries.items():
        node = root
        for c in token:
            node = node.setdefault(c, {})
        node[""] = number
    return root


def word_pieces(vocab: Mapping[str, int], unknown: str = "[UNK]", word: str = r"\S+", lower: bool = True,
                special: Sequence[str] = ()) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A ``make_tokenizer`` for :func:`textlens.operators.scoring.encode_texts`:
    ids of the pieces of every match of ``word``.  ``special`` entries, written
    in square brackets in such vocabularies, are never matched inside words."""
    skipped = {*special, unknown}
    first = {t: i for t, i in vocab.items() if t and not t.startswith("##") and t not in skipped}
    rest = {t[2:]: i for t, i in vocab.items() if t.startswith("##") and len(t) > 2}
    none = vocab[unknown]

    def make() -> Callable[[list[str]], list[list[int]]]:
        begin, inside, memo, find = _trie(first), _trie(rest), {}, re.compile(word).findall

        def pieces(w: str) -> list[int]:
            out, at = [], 0
            while at < len(w):
                node, best, end = (inside if at else begin), None, at
                for k in range(at, len(w)):
                    node = node.get(w[k])
                    if node is None:
                        break
                    if "" in node:
                        best, end = node[""], k + 1
                if best is None:
                    return [none]
                out.append(best)
                at = end
            return out

        def encode(texts: list[str]) -> list[list[int]]:
            ids = []
            for t in texts:
                mine: list[int] = []
                for w in find(t.lower() if lower else t):
                    got = memo.get(w)
                    if got is None:
                        got = [none] if len(w) > MAX_WORD else pieces(w)
                        if len(memo) < _MEMO:
                            memo[w] = got
                    mine += got
                ids.append(mine)
            return ids

        return encode

    return make
