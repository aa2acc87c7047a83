import math

from pyspark.sql import functions as F

from labelforge.functions import scores as S


def test_clamp_round_half_even(spark):
    vals = [0.5, 1.5, 2.5, 3.5, 4.5, -0.7, 7.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(S.score_to_int("x")).collect()]
    assert got == [0, 2, 2, 4, 4, 0, 5, 0]
    assert got[:7] == [int(round(max(0, min(v, 5)))) for v in vals[:7]]


def test_discretize_and_rescale(spark):
    df = spark.createDataFrame([(v,) for v in [-1.2, 0.5, 2.5, 3.2, 9.0]], "x double")
    assert [r[0] for r in df.select(S.discretize("x")).collect()] == [0, 0, 2, 3, 4]
    df2 = spark.createDataFrame([(5,), (4,), (3,), (2,)], "x int")
    assert [r[0] for r in df2.select(S.rescale("x")).collect()] == [4.0, 3.2, 2.4, 1.6]


def test_label_encode_lenient_and_strict(spark):
    import pytest
    df = spark.createDataFrame([("Good",), (S.PROBLEMATIC_LABEL,), ("None",)], "l string")
    assert [r[0] for r in df.select(S.encode_label("l")).collect()] == [3, None, 0]
    with pytest.raises(Exception):
        df.select(S.encode_label("l", strict=True)).collect()


def test_parse_list_text_and_gold(spark):
    df = spark.createDataFrame([("['None' 'Good' 'Good']",), ("['Basic']",), ("[]",)], "s string")
    out = df.select(S.mean_round(S.encode_labels(S.parse_list_text("s"))).alias("g")).collect()
    assert [r[0] for r in out] == [2, 2, None]


def test_llm_score_parse(spark):
    rows = [("Educational score: 3",), ("EDUCATIONAL SCORE:4 then Educational score: 1",),
            ("no score",), ("   ",), (None,), ("Educational score:  12",)]
    df = spark.createDataFrame(rows, "r string")
    assert [r[0] for r in df.select(S.parse_llm_score("r")).collect()] == [3, 4, -1, -1, -1, 12]


def test_json_list_and_display_name(spark):
    df = spark.createDataFrame([("[1, \"x\", 2.5]",), ("[1, 2",)], "s string")
    got = df.select(S.json_list("s").alias("l")).collect()
    assert got[0]["l"] == ["1", "x", "2.5"] and got[1]["l"] == []
    n = spark.range(1).select(S.human_display_name(F.lit("a/b/annotations_jordan.json"))).first()[0]
    assert n == "Human (Jordan)"
    assert math.isfinite(1.0)


def test_llm_score_keeps_raw_and_flags_range(spark):
    from labelforge.operators import inference as I
    df = spark.createDataFrame([(1, "some text"), (2, "   "), (3, None)], "id int, text string")

    def factory():
        import pandas as pd
        return lambda prompts: pd.Series(["Educational score: 7"] * len(prompts), index=prompts.index)
    out = {r["id"]: (r["score"], r["score_in_range"]) for r in
           I.llm_score(df, "text", "head ", " tail", factory).collect()}
    assert out == {1: (7, False), 2: (-1, False), 3: (-1, False)}


def test_with_retries_recovers_and_falls_back(spark):
    import pandas as pd
    from labelforge.operators import inference as I
    calls = {"n": 0}

    def flaky():
        def ask(prompts):
            calls["n"] += 1
            if calls["n"] % 2 == 1:
                raise RuntimeError("transient")
            return pd.Series(["Educational score: 2"] * len(prompts), index=prompts.index)
        return ask

    def broken():
        def ask(prompts):
            raise RuntimeError("down")
        return ask
    s = pd.Series(["a", "b"])
    assert list(I.with_retries(flaky, 3)()(s)) == ["Educational score: 2"] * 2
    assert list(I.with_retries(broken, 2, fallback="")()(s)) == ["", ""]
    df = spark.createDataFrame([(1, "text")], "id int, text string")
    out = I.llm_score(df, "text", "h ", " t", I.with_retries(broken, 2, fallback="")).first()
    assert out["score"] == -1


def test_one_bad_text_costs_only_its_own_row(spark):
    import pandas as pd
    from labelforge.operators import inference as I

    def picky():
        def ask(prompts):
            if prompts.str.contains("poison").any():
                raise RuntimeError("rejected")
            return pd.Series(["Educational score: 4"] * len(prompts), index=prompts.index)
        return ask
    df = spark.createDataFrame([(i, "poison" if i == 3 else "fine") for i in range(8)], "id int, text string").coalesce(1)
    got = {r["id"]: r["score"] for r in I.llm_score(df, "text", "h ", " t", picky).collect()}
    assert got == {i: -1 if i == 3 else 4 for i in range(8)}


def test_translation_keeps_empty_texts(spark):
    from labelforge.operators import inference as I
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "id int, text string")
    got = {r["id"]: r["out"] for r in I.translate(df, "text", "out", lambda: lambda texts: "[da] " + texts).collect()}
    assert got == {1: "", 2: None, 3: "[da] x"}


def test_blank_texts_never_reach_the_client(spark):
    import pandas as pd
    from labelforge.operators import inference as I

    def strict():
        def ask(prompts):
            assert prompts.notna().all() and (prompts.str.len() > 0).all()
            assert not prompts.str.contains("<<BLANK>>").any()
            return pd.Series(["Educational score: 1"] * len(prompts), index=prompts.index)
        return ask
    df = spark.createDataFrame([(1, "fine"), (2, " \t "), (3, None)], "id int, text string")
    got = {r["id"]: r["score"] for r in I.llm_score(df, "text", "<<", ">>", strict).collect()}
    assert got == {1: 1, 2: -1, 3: -1}


def test_parse_list_text_line_breaks_like_python(spark):
    import re
    texts = ["['a\\u2028b' 'c']", "['x\\ny' 'z']", "['None' 'Good']"]
    texts = [t.encode().decode("unicode_escape") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(S.parse_list_text("s")).collect()]
    assert got == [re.findall(r"'(.*?)'", t) for t in texts]


def test_py_format_round_matches_python(spark):
    vals = [0.35, 6.25, 82.15, 2.675, 0.05, 0.15, 1 / 3 * 100, 99.95, 1234.55]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(S.py_format_round("x", 1)).collect()]
    assert got == [float(f"{v:.1f}") for v in vals]


def test_keyed_factories_build_once_per_worker():
    from labelforge.operators import inference as I
    built = {"n": 0}

    def factory():
        built["n"] += 1
        return lambda s: s
    f = I.keyed(factory, "test-model-once")
    assert I.load_model(f) is I.load_model(f) and built["n"] == 1
    assert I.load_model(lambda: 1) == 1
