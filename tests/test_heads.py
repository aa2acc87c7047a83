import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators import agreement as G
from labelforge.operators import ml as ML


def test_gram_parts_add_up_to_least_squares(spark):
    rng = np.random.default_rng(2)
    x, part = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    y = x @ [1.0, -2.0, 0.0, 3.0, 0.5] + 4 + 0.1 * rng.normal(size=300)
    rows = [(int(p), [float(v) for v in r], float(t)) for p, r, t in zip(part, x, y)]
    odd = [(0, None, 1.0), (0, [1.0] * 4, 1.0), (0, [1.0, None, 1.0, 1.0, 1.0], 1.0), (1, [float("nan")] * 5, 1.0),
           (2, [float("inf")] * 5, 1.0), (1, [1.0] * 5, None), (None, [1.0] * 5, 1.0)]
    df = spark.createDataFrame(rows + odd, "part int, x array<double>, y double").repartition(4)
    parts = ML.gram_parts(df, "x", "y", 5, "part")
    assert sorted(parts) == [0, 1, 2] and sum(p[5, 5] for p in parts.values()) == 300
    for keep, reg in (([0], 0.0), ([0, 1, 2], 0.0), ([1, 2], 2.5)):
        mine = np.isin(part, keep)
        z = np.column_stack((x[mine], np.ones(mine.sum())))
        want = np.linalg.solve(z.T @ z + reg * np.diag([1] * 5 + [0]), z.T @ y[mine])
        got = ML.solve_head(sum(parts[k] for k in keep), reg)
        assert np.allclose(got, want)
    out = df.select("x", ML.apply_head(got, "x").alias("q")).where(F.size("x") == 5).where(~F.exists("x", lambda v: v.isNull()))
    for r in out.collect():
        if np.isfinite(r["x"]).all():
            assert np.isclose(r["q"], np.dot(got[:-1], r["x"]) + got[-1])
    assert df.select(ML.apply_head(got, "x").alias("q")).where("q is null").count() >= 2
    assert ML.gram_parts(df.limit(0), "x", "y", 5, "part") == {}


def enumerated_p(d):
    """Two-sided p over all signs of the ranks."""
    rank = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(rank[np.array(d) > 0].sum(), rank[np.array(d) < 0].sum())
    sums = [sum(s) for s in itertools.product(*[(0, int(r)) for r in rank])]
    return min(1.0, 2 * np.mean([s <= w for s in sums]))


@pytest.mark.parametrize("n", [1, 2, 5, 12, 16])
def test_exact_wilcoxon_equals_enumeration(spark, n):
    rng = np.random.default_rng(n)
    d = [float(v) for v in rng.normal(0.3, 1, n)]
    row = G.wilcoxon_signed_rank(spark.createDataFrame([(v,) for v in d + [0.0, 0.0]], "d double")).first()
    assert row["n"] == n and np.isclose(row["p_value"], enumerated_p(d))


def test_wilcoxon_switches_to_the_normal_p(spark):
    rng = np.random.default_rng(7)
    run = lambda d: G.wilcoxon_signed_rank(spark.createDataFrame([(float(v),) for v in d], "d double")).first()
    d50, d51 = rng.normal(size=50), rng.normal(size=51)
    from math import erfc, sqrt
    normal = lambda r: erfc(abs(r["z"]) / sqrt(2))
    assert abs(run(d50)["p_value"] - normal(run(d50))) > 1e-6  # exact
    assert np.isclose(run(d51)["p_value"], normal(run(d51)), rtol=1e-6)
    tied = [1.0, 1.0, -2.0, 3.0, 4.0]
    assert np.isclose(run(tied)["p_value"], normal(run(tied)), rtol=1e-6)
    assert run([0.0, 0.0])["p_value"] is None


def test_token_head_sees_the_first_tokens_only(spark):
    rows = [(i, " ".join(["ab"] * (i % 5) + ["abcd"] * 3 + ["x"] * (2 * i)), float(i % 5)) for i in range(40)]
    odd = [(98, "", 1.0), (99, None, 1.0), (97, " \t ", 1.0), (96, "y" * 40, None)]
    df = spark.createDataFrame(rows + odd, "id int, text string, y double")
    out = df.select("id", ML.token_profile(F.col("text"), 6, 4).alias("p")).collect()
    for r, (i, text, _) in zip(sorted(out, key=lambda r: r["id"])[:40], rows):
        t = text.split()[:6]
        assert r["p"] == [sum(min(len(x), 4) == k for x in t) / len(t) for k in range(1, 5)]
    assert {r["id"]: r["p"] for r in out}[97] == [0.0] * 4 and {r["id"]: r["p"] for r in out}[96] == [0, 0, 0, 1.0]
    head = ML.fit_token_head(df.where("length(text) > 0"), "text", "y", 0.001, max_tokens=6)
    cut = df.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 6), " "))
    assert np.allclose(head, ML.fit_token_head(cut.where("length(text) > 0"), "text", "y", 0.001))
    scored = {r["id"]: r["score"] for r in ML.score_tokens(head, df, max_tokens=6).collect()}
    assert sorted(scored) == sorted([r[0] for r in rows] + [96, 97])
    long_ = {i: s for i, s in scored.items() if i < 40 and i % 5 == 2 and i > 2}
    assert len(set(np.round(list(long_.values()), 9))) == 1  # what differs lies behind the sixth token
    assert ML.fit_token_head(df.limit(0), "text", "y") == [0.0] * (ML.PROFILE + 1)


def test_text_fit_reads_the_texts_once(spark):
    """However often the optimiser and the fit's summary read the rows."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text
    rows = [(f"a{i % 7} b{i % 3} c" * (1 + i % 4), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, y double").repartition(3).withColumn("text", seen("text"))
    model = ML.fit_text_regressor(df, "text", "y", num_features=64, reg=0.1)
    assert read.value == len(rows)
    got = ML.score_text(model, spark.createDataFrame(rows[:3] + [("", 0.0)], "text string, y double"))
    assert got.columns == ["text", "y", "score", "int_score"] and got.count() == 3
