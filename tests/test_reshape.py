import numpy as np

from labelforge.operators import reshape as X
from labelforge.sources import fixtures as V
from tests.conftest import SMALL


def test_histogram_matches_numpy(spark):
    s = V.v_scored(spark, SMALL).select("raw_score")
    vals = np.array([r[0] for r in s.collect()])
    for bins in (30, 20, 7):
        counts, edges = np.histogram(vals, bins=bins)
        got = X.histogram(s, "raw_score", bins).orderBy("bin").collect()
        assert [r["n"] for r in got] == counts.tolist()
        assert np.allclose([r["bin_lo"] for r in got], edges[:-1])


def test_expand_list_width_and_rename(spark):
    df = spark.createDataFrame([(1, "[1, 2, 3]"), (2, "[4]"), (3, "bad")], "id int, s string")
    out = X.expand_list(df, "s", "a", rename={"a_0": "first"}).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 1.0, 2.0, 3.0), (2, 4.0, None, None), (3, None, None, None)]
    assert out[0].__fields__ == ["id", "first", "a_1", "a_2"]


def test_histogram_without_values_and_with_nan(spark):
    from labelforge.operators import reshape as X
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert [(r["bin_lo"], r["bin_hi"], r["n"]) for r in X.histogram(odd, "x", 2).orderBy("bin").collect()] == [
        (1.0, 2.0, 1), (2.0, 3.0, 1)]
    assert X.histogram(odd.where("x > 9 and not isnan(x)"), "x", 2).count() == 0


def test_decode_keeps_values_between_codes(spark):
    from labelforge.functions import scores as S
    df = spark.createDataFrame([(1, 2.7, 2), (2, 2.0, 7), (3, None, -1)], "id int, a double, b int")
    got = [tuple(r) for r in S.decode_frame(df, exclude=["id"]).orderBy("id").collect()]
    assert got == [(1, "2.7", "Basic"), (2, "Basic", "7"), (3, None, "-1")]
