"""Rule-based text-quality filter (blocked words, too short, spam-like).

One projection over the corpus computes every signal with native
expressions; the verdict is a CASE chain with fixed precedence:
too short -> spam-like -> too many blocked words -> clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (lexicon_hits, punct_count, py_split, py_strip,
                              substr_count)

# --- fixed values (must equal the reference for identical verdicts) ---------
# Default Danish blocked-word lexicon: adult content, gambling, financial spam.
DANISH_BLOCKED_WORDS = [
    'escort', 'prostitueret', 'luder', 'bordel', 'massage', 'tantra',
    'sex', 'porno', 'bryster', 'fisse', 'pik', 'kusse', 'anal',
    'blowjob', 'orgasme', 'swingerklub', 'stripper', 'nøgen', 'erotisk',
    'kneppe', 'sutter', 'sprøjte', 'sæd', 'dildo', 'webcam',
    'liderlig', 'frække', 'intim', 'yoni', 'lingam', 'milf', 'shemale',
    'gangbang', 'trekant', 'bdsm', 'fetish', 'latex', 'dominatrix',
    'callgirl', 'sexarbejder', 'pornostjerne', 'swinger', 'cam',
    'xxxs', 'hardcore', 'fetisch', 'kink', 'bondage', 'sadomaso',
    'casino', 'poker', 'gambling', 'spillemaskiner', 'jackpot',
    'betting', 'væddemål', 'odds',
    'kviklån', 'forbrugslån', 'lånebeløb', 'rente', 'åop',
]
REASON_SHORT = "Text too short"
REASON_SPAM = "Spam-like content"
REASON_WORDS = "Contains %d inappropriate words"
REASON_CLEAN = "Clean content"
MIN_STRIPPED_CHARS = 10
MAX_DOUBLE_PIPES = 5
MAX_PIPES = 15
MAX_PUNCT_RATIO = 0.3
MIN_WORDS_FOR_REPEAT = 10
MIN_UNIQUE_RATIO = 0.3
DEFAULT_THRESHOLD = 2
# ---------------------------------------------------------------------------

HELPER_COLUMNS = ["is_problematic", "filter_reason", "bad_word_count"]


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def signals(text: Column, lexicon=DANISH_BLOCKED_WORDS) -> Column:
    """The raw signals of a text as one struct: one word split and one token
    extraction. A null text behaves like the string ``"nan"`` (what
    ``str(nan)`` gives)."""
    raw = _bound(F.coalesce(text.cast("string"), F.lit("nan")), lambda t: F.struct(
        F.length(py_strip(t)).alias("stripped"), F.length(t).alias("length"),
        substr_count(t, "||").alias("pipes2"), substr_count(t, "|").alias("pipes"),
        punct_count(t).alias("punct"), py_split(t).alias("words"),
        lexicon_hits(t, lexicon).alias("bad")))
    return _bound(raw, lambda s: F.struct(
        *[s[k].alias(k) for k in ("stripped", "length", "pipes2", "pipes", "punct", "bad")],
        F.size(s["words"]).alias("n_words"), F.size(F.array_distinct(s["words"])).alias("n_unique")))


def flags(text: Column, lexicon=DANISH_BLOCKED_WORDS) -> Column:
    """The boolean signals and the blocked-word count as one struct."""
    def judge(s):
        table_like = (s["pipes2"] > MAX_DOUBLE_PIPES) | (s["pipes"] > MAX_PIPES)
        punct_heavy = (s["length"] > 0) & (F.try_divide(s["punct"], s["length"]) > MAX_PUNCT_RATIO)
        repetitive = ((s["n_words"] > MIN_WORDS_FOR_REPEAT)
                      & (F.try_divide(s["n_unique"], s["n_words"]) < MIN_UNIQUE_RATIO))
        return F.struct((s["stripped"] < MIN_STRIPPED_CHARS).alias("too_short"), table_like.alias("table_like"),
                        punct_heavy.alias("punct_heavy"), repetitive.alias("repetitive"),
                        (table_like | punct_heavy | repetitive).alias("spam_like"), s["bad"].alias("bad_word_count"))
    return _bound(signals(text, lexicon), judge)


def is_clean(text: Column, lexicon=DANISH_BLOCKED_WORDS, threshold: int = DEFAULT_THRESHOLD) -> Column:
    return _bound(flags(text, lexicon), lambda f: ~(f["too_short"] | f["spam_like"] | (f["bad_word_count"] >= threshold)))


def verdict(text: Column, lexicon=DANISH_BLOCKED_WORDS, threshold: int = DEFAULT_THRESHOLD) -> Column:
    """is_problematic, filter_reason and bad_word_count as one struct. The
    count is there for every text, also for short / spam-like ones."""
    def judge(f):
        n = f["bad_word_count"]
        reason = (F.when(f["too_short"], F.lit(REASON_SHORT)).when(f["spam_like"], F.lit(REASON_SPAM))
                  .when(n >= threshold, F.format_string(REASON_WORDS, n)).otherwise(F.lit(REASON_CLEAN)))
        return F.struct((f["too_short"] | f["spam_like"] | (n >= threshold)).alias("is_problematic"),
                        reason.alias("filter_reason"), n.alias("bad_word_count"))
    return _bound(flags(text, lexicon), judge)


def quality_flags(df: DataFrame, text_col: str = "text",
                  lexicon=DANISH_BLOCKED_WORDS) -> DataFrame:
    """Per-row boolean signals + blocked-word count."""
    return df.withColumn("_q", flags(F.col(text_col), lexicon)).select(*df.columns, "_q.*")


def annotate_quality(df: DataFrame, text_col: str = "text",
                     lexicon=DANISH_BLOCKED_WORDS,
                     threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``is_problematic``, ``filter_reason``, ``bad_word_count``."""
    cols = [c for c in df.columns if c not in HELPER_COLUMNS]
    return df.withColumn("_q", verdict(F.col(text_col), lexicon, threshold)).select(
        *cols, *[F.col(f"_q.{c}").alias(c) for c in HELPER_COLUMNS])


def filter_dataset(df: DataFrame, text_col: str = "text", lexicon=DANISH_BLOCKED_WORDS,
                   threshold: int = DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(clean, problematic): clean drops the helper columns, problematic keeps them.

    To materialise both without scanning twice, use :func:`write_split`.
    """
    clean = df.filter(is_clean(F.col(text_col), lexicon, threshold)).drop(*HELPER_COLUMNS)
    problematic = annotate_quality(df.filter(~is_clean(F.col(text_col), lexicon, threshold)),
                                   text_col, lexicon, threshold)
    return clean, problematic


def write_split(df: DataFrame, path: str, text_col: str = "text",
                lexicon=DANISH_BLOCKED_WORDS, threshold: int = DEFAULT_THRESHOLD,
                fmt: str = "parquet") -> None:
    """One scan, one write: ``path/is_problematic=false`` is the clean set."""
    (annotate_quality(df, text_col, lexicon, threshold)
     .write.mode("overwrite").partitionBy("is_problematic").format(fmt).save(path))


def read_split(spark, path: str, problematic: bool, fmt: str = "parquet") -> DataFrame:
    """One side of a :func:`write_split` output (partition-pruned); the
    clean side drops the helper columns like :func:`filter_dataset`."""
    df = spark.read.format(fmt).load(path).withColumn(
        "is_problematic", F.col("is_problematic").cast("boolean"))
    df = df.filter(F.col("is_problematic") == F.lit(problematic))
    return df if problematic else df.drop(*HELPER_COLUMNS)


def filter_stats(problematic: DataFrame) -> DataFrame:
    """total_filtered, avg_bad_words, max_bad_words (nulls when empty)."""
    return problematic.agg(
        F.count(F.lit(1)).alias("total_filtered"),
        F.avg("bad_word_count").alias("avg_bad_words"),
        F.max("bad_word_count").cast("long").alias("max_bad_words"))


def reason_counts(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("filter_reason").agg(F.count(F.lit(1)).alias("n"))


def retention(annotated: DataFrame) -> DataFrame:
    """Totals and percentages of clean and filtered rows, computed as
    ``part / total * 100`` and shown with one decimal as Python formats it."""
    from ..functions.scores import py_format_round
    total = F.count(F.lit(1))
    clean = F.count_if(~F.col("is_problematic"))
    filtered = F.count_if(F.col("is_problematic"))
    return annotated.agg(total.alias("total"), clean.alias("clean"),
                         filtered.alias("filtered")).select(
        "total", "clean", "filtered",
        py_format_round(F.try_divide(F.col("clean"), F.col("total")) * 100, 1).alias("clean_pct"),
        py_format_round(F.try_divide(F.col("filtered"), F.col("total")) * 100, 1).alias("filtered_pct"))
