"""Column-level text expressions (JVM side, inside whole-stage codegen).

Python's ``str`` methods use Unicode character classes while Java's ``\\w`` /
``\\s`` are ASCII only, so every pattern here spells the Unicode classes out.
The same classes exist in RE2, which the DuckDB oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that reproduce Python's str.isspace()
# and Unicode \w under Java regex.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# The same classes in RE2 spelling (DuckDB oracles).
WS_RE2 = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_WS_RE2 = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD_RE2 = r"[\p{L}\p{N}_]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+$", "")


def ws_tokens(col) -> Column:
    """``str.split()``: whitespace tokens, never an empty token; a NULL text
    has no tokens (an empty array, so sizes are 0 in any ANSI mode)."""
    toks = F.filter(F.split(_c(col), f"{WS}+"), lambda t: t != F.lit(""))
    return F.coalesce(toks, F.array().cast("array<string>"))


# The social-text cleaning patterns, applied in this order
# (mentions and hashtags, URLs, characters other than word characters,
# whitespace and - ' ? . !), then whitespace runs become one space.
MENTION_OR_TAG = f"[@#]{WORD}+"
URL = f"http{NOT_WS}+"
NOT_KEPT = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}\-'?.!]"


def clean_text(col) -> Column:
    """Social-text cleaning: mentions/hashtags, URLs, symbols, spaces.

    Steps, in order: drop ``@word`` / ``#word``; drop ``http`` and the rest of
    its non-space run; drop every character other than word characters,
    whitespace and ``- ' ? . !``; collapse whitespace runs to one space; strip.
    """
    c = F.regexp_replace(_c(col), MENTION_OR_TAG, "")
    c = F.regexp_replace(c, URL, "")
    c = F.regexp_replace(c, NOT_KEPT, "")
    c = F.regexp_replace(c, f"{WS}+", " ")
    return py_strip(c)
