"""Quality-filter queries over ``documents`` (threshold 2, test lexicon)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PUNCT_RE, SPLIT_RE, TOKEN_RE, lexicon_hits, sql_ws_chars
from ..operators import lexicon as LX
from ..operators import quality as Q
from ..sources.fixtures import TEST_LEXICON, _sql_list
from ..sources.tables import documents, table
from .registry import register

DOC_COLS = "doc_id, text, lang, source, n_chars"


def _docs(spark, sf, *cols):
    d = documents(spark, sf)
    return d.select(*cols) if cols else d


# Neutral words of the tables that stand for entries of the default lexicon, so
# that the default list is what is counted.
PLANTED = {"the": "casino", "and": "rente", "der": "poker", "les": "odds", "que": "kviklån"}


def _planted(text):
    for plain, blocked in PLANTED.items():
        text = F.regexp_replace(text, rf"\b{plain}\b", blocked)
    return text


def _annotated(spark, sf, *cols):
    return Q.annotate_quality(_docs(spark, sf, *cols), lexicon=TEST_LEXICON)


# The same signals in DuckDB (RE2 accepts the same character classes).
_SIG = f"""sig AS (
  SELECT {DOC_COLS},
    length(trim(t, {sql_ws_chars()})) AS sl,
    length(t) AS tl,
    (length(t) - length(replace(t, '||', ''))) // 2 AS p2,
    length(t) - length(replace(t, '|', '')) AS p1,
    len(regexp_extract_all(t, '{PUNCT_RE}')) AS pc,
    len(list_filter(regexp_split_to_array(t, '{SPLIT_RE}'), lambda x: x <> '')) AS nw,
    len(list_distinct(list_filter(regexp_split_to_array(t, '{SPLIT_RE}'), lambda x: x <> ''))) AS nu,
    CAST(len(list_filter(regexp_extract_all(lower(t), '{TOKEN_RE}'),
        lambda x: x IN ({_sql_list(TEST_LEXICON)}))) AS BIGINT) AS bad_word_count
  FROM (SELECT *, coalesce(text, 'nan') AS t FROM documents)),
flg AS (
  SELECT *, sl < 10 AS too_short, (p2 > 5 OR p1 > 15) AS table_like,
    (tl > 0 AND pc / tl > 0.3) AS punct_heavy,
    (nw > 10 AND nu / nw < 0.3) AS repetitive FROM sig),
ann AS (
  SELECT *, CASE WHEN too_short THEN 'Text too short'
      WHEN table_like OR punct_heavy OR repetitive THEN 'Spam-like content'
      WHEN bad_word_count >= 2 THEN 'Contains ' || bad_word_count || ' inappropriate words'
      ELSE 'Clean content' END AS filter_reason FROM flg)"""


_PLANT_SQL = "text"
for _plain, _blocked in PLANTED.items():
    _PLANT_SQL = rf"regexp_replace({_PLANT_SQL}, '\b{_plain}\b', '{_blocked}', 'g')"


@register("quality_default_lexicon", f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower({_PLANT_SQL}), '{TOKEN_RE}'),
    lambda x: x IN ({_sql_list(Q.DANISH_BLOCKED_WORDS)}))) AS BIGINT) AS bad_word_count FROM documents WHERE text IS NOT NULL""")
def quality_default_lexicon(spark, sf):
    """The default blocked-word list over the corpus, in which some common
    words were replaced by entries of the list."""
    d = _docs(spark, sf, "doc_id", "text").where(F.col("text").isNotNull())
    a = Q.annotate_quality(d.withColumn("text", _planted(F.col("text"))))
    return a.select("doc_id", F.col("bad_word_count").cast("long"))


@register("badword_count", f"WITH {_SIG} SELECT doc_id, bad_word_count FROM sig")
def badword_count(spark, sf):
    d = _docs(spark, sf, "doc_id", "text")
    hits = lexicon_hits(F.coalesce("text", F.lit("nan")), TEST_LEXICON)
    return d.select("doc_id", hits.cast("long").alias("bad_word_count"))


@register("quality_flags", f"""WITH {_SIG} SELECT doc_id, CAST(too_short AS BIGINT) AS too_short,
    CAST(table_like AS BIGINT) AS table_like, CAST(punct_heavy AS BIGINT) AS punct_heavy,
    CAST(repetitive AS BIGINT) AS repetitive,
    CAST(table_like OR punct_heavy OR repetitive AS BIGINT) AS spam_like, bad_word_count FROM flg""")
def quality_flags(spark, sf):
    d = _docs(spark, sf, "doc_id", "text")
    f = Q.quality_flags(d, lexicon=TEST_LEXICON)
    return f.select("doc_id", *[F.col(c).cast("long").alias(c) for c in
                                ("too_short", "table_like", "punct_heavy", "repetitive",
                                 "spam_like", "bad_word_count")])


@register("quality_reason", f"""WITH {_SIG} SELECT doc_id,
    CAST(filter_reason <> 'Clean content' AS BIGINT) AS is_problematic, filter_reason, bad_word_count
    FROM ann""")
def quality_reason(spark, sf):
    a = _annotated(spark, sf, "doc_id", "text")
    return a.select("doc_id", F.col("is_problematic").cast("long").alias("is_problematic"),
                    "filter_reason", F.col("bad_word_count").cast("long"))


@register("quality_clean", f"WITH {_SIG} SELECT {DOC_COLS} FROM ann WHERE filter_reason = 'Clean content'")
def quality_clean(spark, sf):
    clean, _ = Q.filter_dataset(_docs(spark, sf), lexicon=TEST_LEXICON)
    return clean


@register("quality_problematic", f"""WITH {_SIG} SELECT {DOC_COLS}, TRUE AS is_problematic, filter_reason,
    bad_word_count FROM ann WHERE filter_reason <> 'Clean content'""")
def quality_problematic(spark, sf):
    _, prob = Q.filter_dataset(_docs(spark, sf), lexicon=TEST_LEXICON)
    return prob.withColumn("bad_word_count", F.col("bad_word_count").cast("long"))


@register("quality_stats", f"""WITH {_SIG} SELECT count(*) AS total_filtered,
    round(avg(bad_word_count), 6) AS avg_bad_words, CAST(max(bad_word_count) AS BIGINT) AS max_bad_words
    FROM ann WHERE filter_reason <> 'Clean content'""")
def quality_stats(spark, sf):
    _, prob = Q.filter_dataset(_docs(spark, sf, "doc_id", "text"), lexicon=TEST_LEXICON)
    s = Q.filter_stats(prob)
    return s.withColumn("avg_bad_words", F.round("avg_bad_words", 6))


@register("quality_reasons", f"WITH {_SIG} SELECT filter_reason, count(*) AS n FROM ann GROUP BY filter_reason")
def quality_reasons(spark, sf):
    return Q.reason_counts(_annotated(spark, sf, "text"))


@register("quality_retention", f"""WITH {_SIG} SELECT count(*) AS total,
    count(*) FILTER (WHERE filter_reason = 'Clean content') AS clean,
    count(*) FILTER (WHERE filter_reason <> 'Clean content') AS filtered,
    CAST(format('{{:.1f}}', count(*) FILTER (WHERE filter_reason = 'Clean content') / count(*) * 100) AS DOUBLE)
      AS clean_pct,
    CAST(format('{{:.1f}}', count(*) FILTER (WHERE filter_reason <> 'Clean content') / count(*) * 100) AS DOUBLE)
      AS filtered_pct
    FROM ann""")
def quality_retention(spark, sf):
    return Q.retention(_annotated(spark, sf, "text").select("is_problematic"))


# Entries of more than one word, and with punctuation inside and at the ends (none that can overlap itself, for the oracle).
PHRASES = ["of the", "in the", "the license", ", and", ". the", "l'", "worthless", "-", " as"]
# A phrase is found piece by piece: runs of word characters and runs of others.
_PIECES_SQL = f"""p AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, 'nan')), '{LX.PIECES_RE}') AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], '') AS entry
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM p, (SELECT DISTINCT n FROM e) WHERE len(w) >= n)
      WHERE (i > 1 OR regexp_matches(w[1], '^[{LX.WORD}]'))
        AND (i + n - 1 < len(w) OR regexp_matches(w[len(w)], '^[{LX.WORD}]')))"""


@register("badword_phrases", f"""WITH e AS (SELECT entry, len(regexp_extract_all(entry, '{LX.PIECES_RE}')) AS n
    FROM (SELECT unnest([{_sql_list(PHRASES)}]) AS entry)), {_PIECES_SQL},
    h AS (SELECT doc_id, count(*) AS c FROM g JOIN e USING (entry, n) GROUP BY doc_id)
    SELECT doc_id, coalesce(c, 0) AS bad_word_count FROM documents LEFT JOIN h USING (doc_id)""")
def badword_phrases(spark, sf):
    """A short list of phrases, as literals of the plan."""
    d = _docs(spark, sf, "doc_id", "text")
    hits = lexicon_hits(F.coalesce("text", F.lit("nan")), PHRASES)
    return d.select("doc_id", hits.cast("long").alias("bad_word_count"))


_BENCHMARK_SQL = f"""b AS (SELECT regexp_extract_all(lower(text), '{LX.PIECES_RE}') AS w FROM benchmark),
e AS (SELECT DISTINCT entry, n FROM (
        SELECT n, w[i:i + n - 1] AS x, array_to_string(w[i:i + n - 1], '') AS entry
        FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (SELECT unnest([3, 5]) AS n) WHERE len(w) >= n)
        WHERE regexp_matches(w[i], '^[{LX.WORD}]'))
      WHERE len(list_distinct(list_filter(x, lambda y: regexp_matches(y, '^[{LX.WORD}]')))) = (n + 1) // 2)"""


@register("badword_lexicon_table", f"""WITH {_BENCHMARK_SQL}, {_PIECES_SQL},
    h AS (SELECT doc_id, count(*) AS c FROM g JOIN e USING (entry, n) GROUP BY doc_id)
    SELECT doc_id, coalesce(c, 0) AS bad_word_count FROM documents LEFT JOIN h USING (doc_id)""")
def badword_lexicon_table(spark, sf):
    """A lexicon that is a table: all phrases of two and three different words
    in a row of the benchmark."""
    b = table(spark, sf, "benchmark").select(LX.pieces(F.lower("text")).alias("w"))
    w = F.col("w")

    def phrases(n):
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n))
        return F.when(F.size(w) >= n, F.filter(runs, lambda x: F.get(x, 0).rlike(f"^[{LX.WORD}]") & (
            F.size(F.array_distinct(F.filter(x, lambda y: y.rlike(f"^[{LX.WORD}]")))) == (n + 1) // 2)))
    runs = F.concat(*[F.coalesce(phrases(n), F.array().cast("array<array<string>>")) for n in (3, 5)])
    entries = b.select(F.explode(runs).alias("run")).select(F.array_join("run", "").alias("entry"))
    return LX.count_phrases(_docs(spark, sf, "doc_id", "text"), entries, "doc_id").select("doc_id", "bad_word_count")
