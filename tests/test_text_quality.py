from pyspark.sql import functions as F

from labelforge.operators import quality as Q


def run(spark, texts, lexicon=Q.DANISH_BLOCKED_WORDS, threshold=2):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [(r["filter_reason"], r["bad_word_count"]) for r in
            Q.annotate_quality(df, lexicon=lexicon, threshold=threshold).orderBy("id").collect()]


def test_word_boundaries_follow_python(spark):
    out = run(spark, ["ÅOP og sæd, nøgen og mere tekst her", "sæd_ og xsæd er ikke ord her",
                      "sæd-sæd er to ord i denne tekst"])
    assert out[0] == ("Contains 3 inappropriate words", 3)
    assert out[1][1] == 0
    assert out[2] == ("Contains 2 inappropriate words", 2)


def test_short_and_null(spark):
    out = run(spark, [None, "   kort   ", "  abc\u001c\u000b\u0085"])
    assert [o[0] for o in out] == [Q.REASON_SHORT] * 3


def test_precedence_short_before_spam(spark):
    assert run(spark, ["!!!!!"])[0][0] == Q.REASON_SHORT


def test_pipes_non_overlapping(spark):
    # '|||||' holds 2 non-overlapping '||'; 6 x '||' groups makes it table-like
    txt = "word " + " ".join(["a||b"] * 6)
    assert run(spark, [txt])[0][0] == Q.REASON_SPAM
    txt2 = "a long enough clean sentence |||||"
    assert run(spark, [txt2])[0][0] == Q.REASON_CLEAN


def test_repetitive(spark):
    assert run(spark, [" ".join(["spam"] * 20)])[0][0] == Q.REASON_SPAM


def test_clean_and_problematic_partition_input(spark):
    from tests.conftest import SMALL
    from labelforge.sources.tables import documents
    d = documents(spark, SMALL)
    clean, prob = Q.filter_dataset(d, lexicon=["worthless", "idiot", "license", "licensed"])
    assert clean.count() + prob.count() == d.count()
    assert set(clean.columns) == set(d.columns)
    assert {"is_problematic", "filter_reason", "bad_word_count"} <= set(prob.columns)


def test_stats_empty(spark):
    df = spark.createDataFrame([], "text string, bad_word_count int, is_problematic boolean")
    r = Q.filter_stats(df).first()
    assert r["total_filtered"] == 0 and r["avg_bad_words"] is None


def test_lexicon_rejects_empty_entries(spark):
    import pytest
    from labelforge.functions.text import lexicon_hits
    with pytest.raises(ValueError):
        lexicon_hits(F.col("text"), ["two words", ""])


def test_write_split_one_pass_both_outputs(spark):
    from labelforge.session import scratch_path
    from labelforge.sources.tables import documents
    from tests.conftest import SMALL
    d = documents(spark, SMALL)
    path = scratch_path(spark, "split")
    Q.write_split(d, path, lexicon=["worthless", "idiot", "license", "licensed"])
    clean, prob = Q.filter_dataset(d, lexicon=["worthless", "idiot", "license", "licensed"])
    c2, p2 = Q.read_split(spark, path, False), Q.read_split(spark, path, True)
    assert c2.count() == clean.count() and p2.count() == prob.count()
    assert set(c2.columns) == set(d.columns)
