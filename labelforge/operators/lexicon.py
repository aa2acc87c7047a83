"""Blocked entries of any form against a lexicon table: words, phrases, entries
with punctuation.

An entry counts where it stands in the lower-cased text with a word boundary at
both ends, occurrences of one entry not overlapping. A text is cut into pieces,
runs of word characters and runs of others in turn. Boundaries are exactly where
pieces meet, so an entry stands in a text where pieces in a row equal its own
pieces; an entry that begins (ends) with a run of other characters needs a piece
before (behind) it. So occurrences are found by an equi-join of the texts' piece
n-grams, for the few n that the lexicon has, with the entries. One pattern per n
lists a text's n-grams. No entry is a literal of the plan, and the lexicon is
broadcast only if it is small.

Defined results: a null text is the string ``nan``, like everywhere in the
quality rules; entries are lower-cased, null and empty ones are left out,
repeated ones count once; rows with one id and one text get the same result;
an empty lexicon gives zeros; other columns come back as they are, one named
like the count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, col_of

PIECES_RE = rf"[{WORD}]+|[^{WORD}]+"


def pieces(text) -> Column:
    """Runs of word characters and runs of others, in turn."""
    return F.regexp_extract_all(col_of(text), F.lit(PIECES_RE), 0)


def entries_of(lexicon: DataFrame, entry_col: str = "entry") -> DataFrame:
    """(entry, n_pieces), one row per entry."""
    entry = F.lower(F.col(entry_col).cast("string")).alias("entry")
    return (lexicon.select(entry).where(F.length("entry") > 0).distinct()
            .withColumn("n_pieces", F.size(pieces("entry"))))


def _gram_re(n: int) -> str:
    """Matches a text piece by piece; group 1 is the run of n pieces that begins
    with the matched one, or nothing where that run cannot be an entry's end."""
    word, other, more = f"[{WORD}]++", f"[^{WORD}]++", f"(?=[{WORD}])"
    runs = []
    for pair in ((word, other), (other, word)):
        run = "".join(pair[i % 2] for i in range(n))
        runs.append(run + more if pair[(n - 1) % 2] == other else run)
    return f"(?:(?=({'|'.join(runs)}))|)(?:{word}|{other})"


LONG = 64  # pieces of an entry that one pattern spans


def _grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, tie, n_pieces, at, entry) for all runs of n pieces that can be an
    entry, from (id, tie, low)."""
    short = [n for n in sizes if n <= LONG]
    out = None
    if short:
        # One pass of a pattern per n: the i-th match is the i-th piece.
        runs = rows.select("id", "tie", F.substring("low", 1, 1).rlike(f"[^{WORD}]").alias("other first"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("n_pieces"), F.regexp_extract_all("low", F.lit(_gram_re(n)), 1).alias("runs"))
            for n in short])))
        out = runs.select("id", "tie", "n_pieces", "other first", F.posexplode("runs").alias("at", "entry")).where(
            (F.col("entry") != "") & ~((F.col("at") == 0) & F.col("other first"))).select(
            "id", "tie", "n_pieces", (F.col("at") + 1).alias("at"), "entry")
    if len(short) < len(sizes):
        p = F.col("pieces")
        word_first = F.coalesce(F.get(p, 0).rlike(f"^[{WORD}]"), F.lit(False))
        first = F.when(word_first, 1).otherwise(2)
        last = F.when((F.size(p) % 2 == 1) == word_first, F.size(p)).otherwise(F.size(p) - 1)

        def of(n: int) -> Column:
            starts = F.when(last - (n - 1) >= first, F.sequence(first, last - (n - 1))).otherwise(
                F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.struct(
                F.lit(n).alias("n_pieces"), i.alias("at"), F.array_join(F.slice(p, i, n), "").alias("entry")))
        long_ = rows.select("id", "tie", pieces("low").alias("pieces")).select(
            "id", "tie", F.inline(F.concat(*[of(n) for n in sizes if n > LONG])))
        out = long_ if out is None else out.unionByName(long_)
    return out


BROADCAST = 32 << 20  # bytes of a lexicon that every task gets


def phrase_hits(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text",
                entry_col: str = "entry") -> DataFrame:
    """(id, tie, entry, hits) of all entries that occur; ``tie`` is a hash of
    the text."""
    entries = entries_of(lexicon, entry_col)
    found = entries.groupBy("n_pieces").agg(F.sum(F.octet_length("entry") + 64).alias("bytes")).collect()
    sizes = sorted(r["n_pieces"] for r in found)  # lengths of phrases, a few numbers
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("nan"))
    rows = texts.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.lower(text).alias("low"))
    if not sizes:
        return rows.select("id", "tie", F.lit("").alias("entry"), F.lit(0).cast("long").alias("hits")).limit(0)
    if sum(r["bytes"] for r in found) <= BROADCAST:
        entries = F.broadcast(entries)
    found = _grams(rows, sizes).join(entries, ["entry", "n_pieces"]).groupBy("id", "tie", "entry", "n_pieces").agg(
        F.array_sort(F.collect_set("at")).alias("at"))
    step = F.struct(F.lit(0).alias("next"), F.lit(0).cast("long").alias("n"))
    apart = F.aggregate("at", step, lambda s, at: F.when(at >= s["next"], F.struct(
        (at + F.col("n_pieces")).alias("next"), (s["n"] + 1).alias("n"))).otherwise(s))
    return found.select("id", "tie", "entry", apart["n"].alias("hits"))


def count_phrases(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text", entry_col: str = "entry",
                  name: str = "bad_word_count") -> DataFrame:
    """``df`` with the number of occurrences of all entries in each text."""
    hits = phrase_hits(df, lexicon, id_col, text_col, entry_col).groupBy(
        F.col("id").alias("hit id"), F.col("tie").alias("hit tie")).agg(F.sum("hits").alias("hit count"))
    # The hash is a column of its own, so that the join moves no text that the caller drops.
    tied = df.withColumn("row tie", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("nan"))))
    on = F.col(id_col).eqNullSafe(F.col("hit id")) & (F.col("row tie") == F.col("hit tie"))
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return tied.join(hits, on, "left").select(
        *[tied[c] for c in kept], F.coalesce("hit count", F.lit(0).cast("long")).alias(name))
