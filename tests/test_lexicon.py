import random
import re

from pyspark.sql import functions as F

from labelforge.functions.text import lexicon_hits
from labelforge.operators import lexicon as LX


def by_rule(text, lexicon):
    low = ("nan" if text is None else text).lower()
    return sum(len(re.findall(r"\b" + re.escape(w) + r"\b", low)) for w in {w.lower() for w in lexicon})


ENTRIES = ["a", "b a", "a b a", "a, b", "-", "--", "-a", "a-", "a-b", " ", ". ", "é ü", "Ü.É", "a  b", "a\nb", "_a b_", "x" * 40,
           "\\E", "a\\Eb", "(a)", "a+", "b?", "1 2", "nan", "不 好", "b. a! b"]


def texts(n):
    r = random.Random(5)
    parts = ["a", "b", "é", "ü", "-", "--", " ", " ", ",", ". ", "  ", "\n", "_", "1", "2", "A", "Ü", "不", "好", "(", ")", "+", "?", "! ", "\\E"]
    return [None, "", " ", "a", "a b a b a b a", "-a-", "a-b-a-b", "x" * 40, "NaN"] + [
        "".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(n)]


def test_literals_and_table_follow_the_rule(spark):
    rows = list(enumerate(texts(300)))
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    want = {i: by_rule(t, ENTRIES) for i, t in rows}
    got = df.select("id", lexicon_hits(F.coalesce("text", F.lit("nan")), ENTRIES).alias("n"))
    assert {r["id"]: r["n"] for r in got.collect()} == want
    lexicon = spark.createDataFrame([(e,) for e in ENTRIES + ENTRIES[:3] + [None, ""]], "entry string")
    out = LX.count_phrases(df.withColumn("bad_word_count", F.lit("mine")).withColumn("entry", F.lit("e")), lexicon, "id")
    assert out.columns == ["id", "text", "entry", "bad_word_count"]
    assert {r["id"]: r["bad_word_count"] for r in out.collect()} == want
    each = LX.phrase_hits(df, lexicon, "id").groupBy("entry").agg(F.sum("hits").alias("n"))
    assert {r["entry"]: r["n"] for r in each.collect()} == {
        e: n for e in {e.lower() for e in ENTRIES} if (n := sum(by_rule(t, [e]) for _, t in rows))}


def test_large_lexicon_is_no_literal(spark):
    """1e5 entries, of which the texts hold some; the plan names none."""
    entries = spark.range(100_000).select(F.concat(F.lit("entry "), F.col("id").cast("string")).alias("entry"))
    df = spark.createDataFrame([(i, f"An ENTRY {i * 7} and entry {i}; entry-{i}, entry {i}0") for i in range(50)], "id int, text string")
    out = LX.count_phrases(df, entries, "id")
    plan = out._jdf.queryExecution().toString()
    assert "entry 99" not in plan and len(plan) < 100_000
    assert [r["bad_word_count"] for r in out.orderBy("id").collect()] == [2] + [3] * 49  # "entry 00" is none


def test_odd_rows(spark):
    none = spark.createDataFrame([], "entry string")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "b"), (None, "a b"), (2, None)], "id int, text string")
    assert [r[0] for r in LX.count_phrases(df, none, "id").select("bad_word_count").collect()] == [0] * 5
    one = spark.createDataFrame([("a b",), ("nan",)], "entry string")
    got = sorted(((r["id"] or 0, r["text"] or "", r["bad_word_count"]) for r in LX.count_phrases(df, one, "id").collect()))
    assert got == [(0, "a b", 1), (1, "a b", 1), (1, "a b", 1), (1, "b", 0), (2, "", 1)]
    assert LX.count_phrases(df.limit(0), one, "id").count() == 0


def test_characters_of_two_units_and_long_entries(spark):
    """Letters and signs beyond the first plane, at entries' ends too, and an entry of more pieces than one pattern spans."""
    long_ = " ".join(f"w{i}" for i in range(50))
    entries = ["𝒜", "𝒜 b", "b 𝒜", "😀", "b😀", "😀b", "𝒜😀b", "a b c", "a b c d", long_, long_ + "."]
    rows = list(enumerate(["𝒜 b 𝒜", "b😀b 😀", "😀 b", "𝒜😀b😀", "a b c d a b c", "a b c d.", f"x {long_} y. {long_}.", f"{long_}. b", "b"]))
    df = spark.createDataFrame(rows, "id int, text string")
    lexicon = spark.createDataFrame([(e,) for e in entries], "entry string")
    got = {r["id"]: r["bad_word_count"] for r in LX.count_phrases(df, lexicon, "id").collect()}
    assert got == {i: by_rule(t, entries) for i, t in rows} and sum(got.values()) > 15


def test_no_expression_per_piece_and_no_text_moved(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "id int, text string")
    lexicon = spark.createDataFrame([("a b",), ("b",)], "entry string")
    out = LX.count_phrases(df, lexicon, "id").select("id", "bad_word_count")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "lambda" not in plan.split("Join Inner")[-1]
    assert [r["bad_word_count"] for r in out.orderBy("id").collect()] == [2] * 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = LX.count_phrases(df, lexicon, "id").select("id", "bad_word_count")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = joined.split("Join LeftOuter")[1].splitlines()[1]
    assert "text" in left and left.count("AS row tie") == 1 and "text#" not in left.split("xxhash64")[0]
