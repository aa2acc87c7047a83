import numpy as np
from pyspark.sql import functions as F

from labelforge.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string"


def brute(rows, k, every):
    vec = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        vec.setdefault(i, []).append([int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for q, many in vec.items():
        if q % every == 0:
            for a in many:
                s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, bs in vec.items() if i != q
                           for b in bs if len(a) == len(b))[:k]
                out += [(q, r, i, -t) for r, (t, i) in enumerate(s, 1)]
    return sorted(out)


def run(spark, rows, k=10, every=5, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", "x")
                                for i, v in rows], SCHEMA).repartition(3)
    out = kdtree.top_k(spark, df, F.col("id") % every == 0, k=k, **kw)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8)) for i in range(400)]
    rows += [(400 + i, rng.integers(-2, 3, 8) / 4.0) for i in range(300)]  # many ties
    rows += [(700 + i, np.full(8, 0.5)) for i in range(200)]  # one common vector
    monkeypatch.setattr(kdtree, "QUERY_BLOCK", 50)  # several blocks
    assert run(spark, rows) == brute(rows, 10, 5)


def test_propagated_bound_over_many_shards():
    rng = np.random.default_rng(2)
    points = rng.integers(-300, 300, (5000, 6))
    query, best = rng.integers(-300, 300, 6), []
    for a in range(0, 5000, 700):
        tree = kdtree.Tree(np.arange(a, min(a + 700, 5000)), points[a:a + 700])
        tree.search(-1, query, tree.bounds(query[None])[0], 10, best)
    want = sorted((-int(s), i) for i, s in enumerate(points @ query))[:10]
    assert sorted((-s, -i) for s, i in best) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 1.0]), (None, [9.0, 9.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0]), (7, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 10, 5) == [(0, 1, 6, 3145728), (0, 2, 7, 3145728), (10, 1, 11, 14680064)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
