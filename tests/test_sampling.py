import hashlib

import pytest
from pyspark.sql import functions as F

from labelforge.operators import sampling as R
from labelforge.sources import fixtures as V
from tests.conftest import SMALL


def test_sample_n_exact_and_partition_invariant(spark):
    s = V.v_scored(spark, SMALL).select("doc_id")
    a = {r[0] for r in R.sample_n(s, 37, "doc_id", 42).collect()}
    b = {r[0] for r in R.sample_n(s.repartition(7), 37, "doc_id", 42).collect()}
    assert len(a) == 37 and a == b
    assert R.sample_n(s, 10 ** 6, "doc_id").count() == s.count()
    assert R.sample_n(s, 0, "doc_id").count() == 0 and R.sample_n(s, -1, "doc_id").count() == s.count()


def test_quotas_never_exceeded(spark):
    s = V.v_scored(spark, SMALL).select("doc_id", "int_score")
    out = R.cap_per_class(s, "int_score", {0: 5, 1: 3, 2: 0, 3: 7, 4: 2}, "doc_id")
    counts = {r[0]: r[1] for r in out.groupBy("int_score").count().collect()}
    assert counts.get(0, 0) <= 5 and counts.get(1, 0) <= 3 and 2 not in counts
    assert counts.get(5, 0) == s.filter(F.col("int_score") == 5).count()


def test_split_sizes_and_positions(spark):
    s = V.v_scored(spark, SMALL).select("doc_id")
    n = s.count()
    out = R.train_val_split(s, 0.2, "doc_id", 42)
    assert out.filter(F.col("split") == "train").count() == int((1 - 0.2) * n)
    pos = R.global_position(s.repartition(5), ["doc_id"]).collect()
    assert sorted(r["pos"] for r in pos) == list(range(1, n + 1))
    assert all(r["pos"] == i + 1 for i, r in enumerate(sorted(pos, key=lambda r: r["doc_id"])))


@pytest.mark.parametrize("buckets", [1 << 16, 4])
def test_selections_match_a_plain_sort(spark, monkeypatch, buckets):
    """Also with 4 histogram buckets, where the last step sees many keys."""
    monkeypatch.setattr(R, "BUCKETS", buckets)
    ids = [3, 5, -9, 10 ** 15, 7, 8, 12, 2 ** 62, -2 ** 61] + list(range(100, 190))
    rows = [(i, (None, 0, 1, 3, 4, 5)[i % 6], "text") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, int_score int, text string").repartition(4)
    for n in (1, 4, 50, 99, 1000):
        assert sorted(r[0] for r in R.first_n(df, n, "doc_id").collect()) == sorted(ids)[:n]
        want = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:n]
        assert sorted(r[0] for r in R.sample_n(df, n, "doc_id", 42).collect()) == sorted(want)
    quotas = {0: 5, 1: 3, 3: 0, 4: 1000}
    want = [i for i in ids if i % 6 == 5]
    for k, c in ((1, 0), (2, 1), (3, 3), (4, 4)):
        want += sorted(i for i in ids if i % 6 == k)[:quotas[c]]
    assert sorted(r[0] for r in R.cap_per_class(df, "int_score", quotas, "doc_id").collect()) == sorted(want)
    split = R.train_val_split(df, 0.2, "doc_id", 42, stratify_col="int_score")
    got = {(r["int_score"], r["split"]): r["count"] for r in split.groupBy("int_score", "split").count().collect()}
    for c in (None, 0, 1, 3, 4, 5):
        n = sum(r[1] == c for r in rows)
        assert got.get((c, "train"), 0) == int((1 - 0.2) * n) and sum(v for k, v in got.items() if k[0] == c) == n


def test_selection_moves_keys_only(spark):
    df = V.v_scored(spark, SMALL).select("doc_id", "text")
    plan = R.first_n(df, 20, "doc_id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("text" in line for line in exchanges)


def test_empty_selections(spark):
    df = spark.createDataFrame([], "doc_id long, int_score int")
    assert R.first_n(df, 3, "doc_id").count() == R.sample_n(df, 3, "doc_id").count() == 0
    assert R.cap_per_class(df, "int_score", {0: 2}, "doc_id").count() == 0
    assert R.train_val_split(df, 0.2, "doc_id").count() == 0


def test_pool_stats_from_counts_match_row_form(spark):
    import random
    from labelforge.operators import agreement as G
    rnd = random.Random(1)
    rows = [(i, f"r{j}", rnd.randint(0, 4)) for i in range(40) for j in range(rnd.randint(1, 6))]
    r = spark.createDataFrame(rows, "item long, rater string, score int")
    present = r.select("item", F.col("score").alias("pool")).distinct()
    pools = r.join(present, "item")
    a = {x["pool"]: round(x["alpha"], 9) for x in G.krippendorff_alpha(pools, "ordinal", ["pool"]).collect()}
    m = {x["pool"]: round(x["msd"], 9) for x in G.msd(pools, ["pool"]).collect()}
    t = G.statistics_from_counts(G.pool_counts(r), ["pool"]).collect()
    assert a == {x["pool"]: round(x["alpha_ordinal"], 9) for x in t}
    assert m == {x["pool"]: round(x["msd"], 9) for x in t}


def test_biased_sample_topup_reaches_n(spark):
    from labelforge.functions import scores as S
    p = V.v_panel_text(spark, SMALL).select(
        "doc_id", S.parse_list_text("educational_value_labels").alias("labels"),
        "problematic_content_label_present")
    base = p.filter((F.col("problematic_content_label_present") == F.lit(False)) & (F.size("labels") > 2))
    kept = R.biased_sample(p, 1, 0.7, "doc_id", "labels", "problematic_content_label_present").count()
    n = kept + 7
    out = R.biased_sample(p, n, 0.7, "doc_id", "labels", "problematic_content_label_present")
    rows = out.collect()
    assert len(rows) == min(n, base.count())
    assert sorted(r["pos"] for r in rows) == list(range(1, len(rows) + 1))


def test_null_and_repeated_keys_keep_the_counts(spark):
    """1,000 rows of which 20 have no id; quotas that reach into the nulls."""
    rows = [(None if i % 50 == 0 else i, i % 4, f"text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, int_score int, text string").repartition(4)
    ids = [r[0] for r in rows if r[0] is not None]
    by_hash = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for n in (10, 980):
        assert sorted(r[0] for r in R.sample_n(df, n, "doc_id").collect()) == sorted(by_hash[:n])
    for n in (981,):
        got = [r[0] for r in R.sample_n(df, n, "doc_id").collect()]
        assert len(got) == n and got.count(None) == n - 980
        assert sorted(R.sample_n(df, n, "doc_id").collect(), key=str) == sorted(
            R.sample_n(df.repartition(7), n, "doc_id").collect(), key=str)
    assert R.first_n(df, 990, "doc_id").count() == 980
    split = R.train_val_split(df, 0.2, "doc_id").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {"train": 800, "validation": 200}
    bare = spark.createDataFrame([(None, i % 2) for i in range(20)] + [(i, i % 2) for i in range(10)],
                                 "doc_id long, int_score int")
    for quota in (3, 8):
        out = R.cap_per_class(bare, "int_score", {0: quota, 1: 30}, "doc_id")
        assert {r[0]: r[1] for r in out.groupBy("int_score").count().collect()} == {0: quota, 1: 15}
        kept = [r[0] for r in out.where("int_score = 0").collect()]
        assert sorted(i for i in kept if i is not None) == [0, 2, 4, 6, 8][:quota]


@pytest.mark.parametrize("text", [True, False])
def test_repeated_ids_are_counted_one_by_one(spark, text):
    rows = [(i % 10, i % 3, f"text {i}" if text else "text") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, int_score int, text string").repartition(3)
    for n in (15, 20, 200):
        assert R.sample_n(df, n, "doc_id").count() == min(n, 100)
        first = [r[0] for r in R.first_n(df, n, "doc_id").collect()]
        assert sorted(first) == sorted(r[0] for r in rows)[:n]
    if text:
        assert sorted(R.first_n(df, 15, "doc_id").collect()) == sorted(R.first_n(df.repartition(8), 15, "doc_id").collect())
    out = R.cap_per_class(df, "int_score", {0: 7, 1: 12}, "doc_id", unlimited=(2,))
    assert {r[0]: r[1] for r in out.groupBy("int_score").count().collect()} == {0: 7, 1: 12, 2: 33}
    split = R.train_val_split(df, 0.25, "doc_id", stratify_col="int_score")
    got = {(r[0], r[1]): r[2] for r in split.groupBy("int_score", "split").count().collect()}
    assert got[(0, "train")] + got[(1, "train")] + got[(2, "train")] == 25 + 24 + 24


def test_apportionment(spark):
    assert R.apportion({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert R.apportion({"a": 7, "b": 2, "c": 1}, 8) == {"a": 6, "b": 1, "c": 1}
    assert R.apportion({}, 5) == {} and R.apportion({"a": 0}, 0) == {"a": 0}
    rows = [(i, None if i % 10 == 0 else i % 3 if i % 7 else 5) for i in range(101)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(3)
    got = {(r[0], r[1]): r[2] for r in R.stratified_split(df, 0.3, "id", "label").groupBy("label", "split").count().collect()}
    sizes = {c: sum(r[1] == c for r in rows) for c in (0, 1, 2, 5, None)}
    assert {c: got[c, "train"] for c in sizes} == R.apportion(sizes, 70) and sum(got.values()) == 101
    assert R.stratified_split(df.limit(0), 0.3, "id", "label").count() == 0
