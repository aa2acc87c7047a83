import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from labelforge.operators import agreement as G
from labelforge.operators import metrics as MT


def long_frame(spark, t, p, raw=None, model="m"):
    rows = [(model, a, b, (raw[i] if raw else None)) for i, (a, b) in enumerate(zip(t, p))]
    return spark.createDataFrame(rows, "model_name string, true_label int, final_prediction int, raw_prediction double")


def test_f1_macro_observed_union(spark):
    s = MT.summary(long_frame(spark, [0, 1, 2], [0, 1, -1]), digits=None).first()
    assert s["f1_macro"] == pytest.approx(0.5)  # classes {-1,0,1,2}, not 2/3
    assert s["accuracy"] == pytest.approx(2 / 3)
    assert s["mse"] == pytest.approx((0 + 0 + 9) / 3)


def test_report_uses_micro_avg_with_stray_labels(spark):
    r = MT.classification_report(long_frame(spark, [0, 1, 2], [0, 1, -1]))
    classes = {row["class"] for row in r.collect()}
    assert "micro avg" in classes and "None" in classes


def test_golden_summary_rounding(spark):
    # unrounded per-model metrics -> half-even 4 places, sorted by f1_macro desc
    rows = [("zeroshot", 0.55604088306427, 0.47, 0.386632952301155, 0.41572386139206424),
            ("Full-finetune", 0.477205365896225, 0.51, 0.511031488249473, 0.5056727335290161),
            ("fewshot-250-samples", 0.6564090251922607, 0.42, 0.3736230110159119, 0.34048347613219093),
            ("fewshot-1000-samples", 0.5658248662948608, 0.48, 0.4426584928229665, 0.4304336124401914),
            ("fewshot-2500-samples", 0.5906309485435486, 0.45, 0.4236866075101369, 0.4054698242933537)]
    df = spark.createDataFrame(rows, "model_name string, mse double, accuracy double, f1_macro double, f1_weighted double")
    from labelforge.functions.scores import np_round
    out = df.select("model_name", *[np_round(c, 4).alias(c) for c in df.columns[1:]]) \
        .orderBy(F.desc("f1_macro")).collect()
    assert [r["model_name"] for r in out] == ["Full-finetune", "fewshot-1000-samples", "fewshot-2500-samples",
                                              "zeroshot", "fewshot-250-samples"]
    assert (out[0]["mse"], out[0]["f1_macro"], out[0]["f1_weighted"]) == (0.4772, 0.511, 0.5057)
    assert (out[3]["mse"], out[3]["f1_macro"]) == (0.556, 0.3866)


def ratings(spark, score_lists):
    rows = [(i, f"r{j}", s) for i, ss in enumerate(score_lists) for j, s in enumerate(ss)]
    return spark.createDataFrame(rows, "item long, rater string, score int")


def test_msd_closed_form_equals_pair_loop(spark):
    rnd = random.Random(7)
    data = [[rnd.randint(0, 4) for _ in range(rnd.randint(2, 7))] for _ in range(40)]
    got = G.msd(ratings(spark, data)).first()["msd"]
    per = [2 / (len(s) * (len(s) - 1)) * sum((a - b) ** 2 for a, b in itertools.combinations(s, 2)) for s in data]
    assert got == pytest.approx(sum(per) / len(per))


def _alpha_pairs(data, level):
    values = sorted({v for s in data if len(s) > 1 for v in s})
    n = {v: sum(s.count(v) for s in data if len(s) > 1) for v in values}
    N = sum(n.values())

    def d2(a, b):
        if level == "nominal":
            return 0.0 if a == b else 1.0
        lo, hi = min(a, b), max(a, b)
        return (sum(n[g] for g in values if lo <= g <= hi) - (n[a] + n[b]) / 2) ** 2

    do = 0.0
    for s in data:
        if len(s) < 2:
            continue
        for i, a in enumerate(s):
            for j, b in enumerate(s):
                if i != j:
                    do += d2(a, b) / (len(s) - 1)
    de = sum(n[a] * n[b] * d2(a, b) for a in values for b in values) / (N - 1)
    return 1 - do / de


@pytest.mark.parametrize("level", ["nominal", "ordinal"])
def test_alpha_matches_pair_loop(spark, level):
    rnd = random.Random(3)
    data = [[rnd.randint(0, 4) for _ in range(rnd.randint(1, 6))] for _ in range(60)]
    got = G.krippendorff_alpha(ratings(spark, data), level).first()["alpha"]
    assert got == pytest.approx(_alpha_pairs(data, level))


def test_alpha_perfect_and_single_rater(spark):
    data = [[1, 1, 1], [3, 3], [0, 0, 0, 0], [2]]
    assert G.krippendorff_alpha(ratings(spark, data), "ordinal").first()["alpha"] == pytest.approx(1.0)


def test_nominal_alpha_and_kappa_permutation_invariant(spark):
    rnd = random.Random(11)
    data = [[rnd.randint(0, 4) for _ in range(4)] for _ in range(30)]
    perm = {0: 3, 1: 0, 2: 4, 3: 1, 4: 2}
    pd_ = [[perm[x] for x in s] for s in data]
    a1 = G.krippendorff_alpha(ratings(spark, data), "nominal").first()["alpha"]
    a2 = G.krippendorff_alpha(ratings(spark, pd_), "nominal").first()["alpha"]
    k1 = G.fleiss_kappa(ratings(spark, data)).first()["kappa"]
    k2 = G.fleiss_kappa(ratings(spark, pd_)).first()["kappa"]
    assert a1 == pytest.approx(a2) and k1 == pytest.approx(k2)


def test_interval_simple_equals_interval_alpha_for_equal_counts(spark):
    rnd = random.Random(5)
    data = [[rnd.randint(0, 4) for _ in range(3)] for _ in range(50)]
    r = ratings(spark, data)
    a = G.krippendorff_alpha(r, "interval").first()["alpha"]
    b = G.interval_alpha_simple(r).first()["alpha"]
    assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_wilcoxon_ties_and_p(spark):
    d = spark.createDataFrame([(float(x),) for x in [1, -2, 3, 0, 1, -1, 2, 4, -3, 5]], "d double")
    r = G.wilcoxon_signed_rank(d).first()
    # |d| ranks: 1,1,1 -> 2 ; 2,2 -> 4.5 ; 3,3 -> 6.5 ; 4 -> 8 ; 5 -> 9
    assert r["n"] == 9 and r["w_minus"] == pytest.approx(2 + 4.5 + 6.5)
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-6)


def test_ordered_pair_normalised_variant_equals_simple_alpha(spark):
    # ordered pairs with distances scaled by (R-1): the scale cancels in D_o/D_e
    rnd = random.Random(9)
    data = [[rnd.randint(0, 4) for _ in range(4)] for _ in range(30)]
    R = 5
    do = sum(((a - b) / (R - 1)) ** 2 for s in data for i, a in enumerate(s) for j, b in enumerate(s) if i != j)
    do /= sum(len(s) * (len(s) - 1) for s in data)
    pooled = [x for s in data for x in s]
    n = len(pooled)
    de = sum(((a - b) / (R - 1)) ** 2 for i, a in enumerate(pooled) for j, b in enumerate(pooled) if i != j)
    de /= n * (n - 1)
    g4 = 1 - do / de
    g3 = G.interval_alpha_simple(ratings(spark, data)).first()["alpha"]
    assert g3 == pytest.approx(g4)


def test_missing_ratings_are_no_ratings(spark):
    data = [[0, 1, None, 4], [2, None, 2, 2], [None, 4, 3, 4], [1, 1, 1, 0]]
    full = [[x for x in s if x is not None] for s in data]
    rows = [(i, f"r{j}", x) for i, s in enumerate(data) for j, x in enumerate(s)]
    r = spark.createDataFrame(rows, "item long, rater string, score int")
    for level in ("nominal", "ordinal"):
        assert G.krippendorff_alpha(r, level).first()["alpha"] == pytest.approx(_alpha_pairs(full, level))
    same = ratings(spark, full)
    assert G.mean_entropy(r).first() == G.mean_entropy(same).first()
    assert G.interval_alpha_simple(r).first()["alpha"] == pytest.approx(G.interval_alpha_simple(same).first()["alpha"])
    assert G.fleiss_kappa(r).first()["kappa"] is None  # ragged


def test_ragged_kappa_is_null_and_zero_rows_stay(spark):
    assert G.fleiss_kappa(ratings(spark, [[0, 1, 1], [2, 2], [3, 3, 4]])).first()["kappa"] is None
    t = {r["item"]: tuple(r)[1:] for r in G.category_table(ratings(spark, [[0, 9], [8, 9]])).collect()}
    assert t == {0: (1, 0, 0, 0, 0), 1: (0, 0, 0, 0, 0)}
    assert G.fleiss_kappa(ratings(spark, [[0, 1], [8, 9]])).first()["kappa"] is None


def test_category_table_counts(spark):
    t = G.category_table(ratings(spark, [[0, 0, 4], [1, 2, 2]])).orderBy("item").collect()
    assert [tuple(r)[1:] for r in t] == [(2, 0, 0, 0, 1), (0, 1, 2, 0, 0)]


def test_wilcoxon_test_dict(spark):
    rows = []
    rnd = random.Random(4)
    for i in range(60):
        for j in range(3):
            rows.append((i, f"o{j}", rnd.randint(0, 4), "own"))
            rows.append((i, f"e{j}", rnd.choice([0, 4]), "external"))
    r = spark.createDataFrame(rows, "item long, rater string, score int, group string")
    out = G.wilcoxon_test(r, "own", "external")
    assert out["n"] > 0 and 0 <= out["p_value"] <= 1 and out["w"] == min(out["w_plus"], out["w_minus"])


def test_hot_item_holding_a_third_of_ratings(spark):
    # one item carries a third of all ratings; results must equal the pair loop
    rnd = random.Random(21)
    data = [[rnd.randint(0, 4) for _ in range(rnd.randint(2, 5))] for _ in range(150)]
    data.append([rnd.randint(0, 4) for _ in range(sum(len(s) for s in data) // 2)])
    r = ratings(spark, data).repartition(6)
    assert G.krippendorff_alpha(r, "ordinal").first()["alpha"] == pytest.approx(_alpha_pairs(data, "ordinal"))
    per = [2 / (len(s) * (len(s) - 1)) * sum((a - b) ** 2 for a, b in itertools.combinations(s, 2)) for s in data]
    assert G.msd(r).first()["msd"] == pytest.approx(sum(per) / len(per))


def test_drop_sentinels_option(spark):
    long = long_frame(spark, [0, 1, 2, 3], [0, 1, -1, 5])
    kept = MT.summary(long, digits=None).first()
    dropped = MT.summary(MT.drop_sentinels(long), digits=None).first()
    assert kept["accuracy"] == pytest.approx(0.5) and dropped["accuracy"] == pytest.approx(1.0)
