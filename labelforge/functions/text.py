"""Text expressions with Python ``str`` semantics, written as native Spark
column expressions (JVM-side, whole-stage codegen; no UDF).

Python's ``str.split()`` / ``strip()`` use Unicode whitespace and ``\\w`` is
letters + digits + underscore (combining marks excluded). Java's ``\\s`` and
``\\w`` differ from both, so the character classes are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace exactly as Python's str.isspace() defines it (derived
# from the running interpreter, not listed by hand).
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
# The same set as a regex character-class body (Java and RE2 both accept \x{h}).
WS = "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS)
# Python's \w for str patterns.
WORD = r"\p{L}\p{N}_"

STRIP_RE = rf"^[{WS}]+|[{WS}]+$"
SPLIT_RE = rf"[{WS}]+"
TOKEN_RE = rf"[{WORD}]+"
PUNCT_RE = rf"[^{WORD}{WS}]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` — a character-set trim, no regex."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def sql_ws_chars() -> str:
    """The whitespace set as a DuckDB string expression."""
    return " || ".join(f"chr({ord(c)})" for c in WS_CHARS)


def py_split(c) -> Column:
    """``str.split()`` — whitespace runs, empty tokens removed."""
    return F.filter(F.split(col_of(c), SPLIT_RE), lambda x: x != F.lit(""))


def word_tokens(c) -> Column:
    """Maximal runs of word characters (what ``\\b…\\b`` delimits)."""
    return F.regexp_extract_all(col_of(c), F.lit(TOKEN_RE), 0)


def punct_count(c) -> Column:
    """Count of ``[^\\w\\s]`` characters."""
    return F.regexp_count(col_of(c), F.lit(PUNCT_RE))


def substr_count(c, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` (``str.count``)."""
    c = col_of(c)
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit(""))))
                   / F.lit(len(needle))).cast("long")


def is_word_char(ch: str) -> bool:
    """Python's ``\\w`` for one character."""
    return ch.isalnum() or ch == "_"


def bounded_re(entry: str) -> str:
    """``\\b`` + the literal entry + ``\\b`` with Python's word characters."""
    before = rf"(?<![{WORD}])" if is_word_char(entry[0]) else rf"(?<=[{WORD}])"
    behind = rf"(?![{WORD}])" if is_word_char(entry[-1]) else rf"(?=[{WORD}])"
    quoted = "\\Q" + entry.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return before + quoted + behind


def lexicon_hits(c, lexicon) -> Column:
    """Occurrences of lexicon entries in lower-cased text, with a word boundary
    at both ends of an entry.

    For entries that are one word, counting ``\\bw\\b`` matches for every ``w``
    equals counting tokens that belong to the lexicon: one regex pass per text
    instead of one per word. Phrases and entries with punctuation take a pass
    each; for a lexicon with many of those, or a table, see
    :mod:`labelforge.operators.lexicon`.
    """
    entries = {w.lower() for w in lexicon}
    if "" in entries:
        raise ValueError("an empty lexicon entry")
    words = sorted(w for w in entries if all(is_word_char(ch) for ch in w))
    text = F.lower(col_of(c))
    hits = F.size(F.filter(word_tokens(text), lambda x: x.isin(words))) if words else F.lit(0)
    for phrase in sorted(entries.difference(words)):
        hits = hits + F.regexp_count(text, F.lit(bounded_re(phrase)))
    return hits
