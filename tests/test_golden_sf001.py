"""Expected values at sf0.01 listed in FIXTURES.md §C."""

import pytest

import __spark_entry__ as E
from labelforge.operators import metrics as MT
from labelforge.plans.eval_queries import master

SF = "/root/testdata/sf0.01"


def test_quality_reasons(spark):
    got = {r["filter_reason"]: r["n"] for r in E.queries()["quality_reasons"](spark, SF).collect()}
    assert got == {"Clean content": 821, "Spam-like content": 128, "Text too short": 4,
                   "Contains 2 inappropriate words": 35, "Contains 3 inappropriate words": 7,
                   "Contains 4 inappropriate words": 1, "Contains 5 inappropriate words": 2,
                   "Contains 6 inappropriate words": 1, "Contains 8 inappropriate words": 1}


def test_alpha_values(spark):
    nom = {r["dataset"]: r["alpha"] for r in E.queries()["alpha_nominal"](spark, SF).collect()}
    ordn = {r["dataset"]: r["alpha"] for r in E.queries()["alpha_ordinal"](spark, SF).collect()}
    assert nom == {"ratings": pytest.approx(-0.000325, abs=1e-6), "panel": pytest.approx(0.006932, abs=1e-6)}
    assert ordn == {"ratings": pytest.approx(0.000736, abs=1e-6), "panel": pytest.approx(0.067927, abs=1e-6)}


def test_wilcoxon(spark):
    r = E.queries()["wilcoxon"](spark, SF).first()
    assert (r["n"], r["w"]) == (844, 136899.5) and r["z"] == pytest.approx(-5.854485, abs=1e-6)


def test_model_metrics(spark):
    s = {r["model_name"]: r for r in MT.summary(master(spark, SF), digits=6).collect()}
    expected = {"fewshot_250": (0.544125, 0.521, 0.513377, 0.515176),
                "fewshot_1000": (0.581328, 0.508, 0.502311, 0.504399),
                "full_finetune": (0.559547, 0.514, 0.504398, 0.50648),
                "llm_rubric": (4.374, 0.183, 0.136636, 0.191495)}
    for m, vals in expected.items():
        r = s[m]
        assert (r["mse"], r["accuracy"], r["f1_macro"], r["f1_weighted"]) == pytest.approx(vals, abs=1e-6)
