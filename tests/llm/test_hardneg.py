import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score string, anchor string, id string"


def brute(rows, every, positives, negatives, scale=256):
    good = [(i, lab, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, other, w in good
                        if i != a and len(w) == len(v))
        for s, i, _ in [o for o in others if o[2]][:positives]:
            hard = [o for o in others if not o[2] and -30 * s <= -100 * o[0] <= -90 * s][:negatives]
            out += [(a, i, r, o[1], -s, -o[0]) for r, o in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, every=5, positives=5, negatives=10, **kw):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], lab, "s", "a", "x")
            for i, v, lab in rows]
    out = hardneg.mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % every == 0,
                       positives=positives, negatives=negatives, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, centres[rng.integers(6)] + 0.2 * rng.normal(size=8), int(rng.integers(4))) for i in range(n)]
    rows += [(n + i, rng.integers(-2, 3, 8) / 4.0, int(rng.integers(4))) for i in range(150)]  # many ties
    return rows + [(n + 150 + i, np.full(8, 0.5), i % 2) for i in range(150)]  # one common vector


@pytest.mark.parametrize("sizes", [(256, 4096, 4096), (8, 40, 70)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("TREE_ANCHORS", "BLOCK_ANCHORS", "SHARD_ROWS"), sizes):
        monkeypatch.setattr(hardneg, name, size)
    rows = clustered(sum(sizes), 500)
    want = brute(rows, 5, 5, 10)
    assert len(want) > 2000
    assert run(spark, rows) == want
    assert run(spark, rows, positives=1, negatives=3) == brute(rows, 5, 1, 3)


def test_spanning_tree():
    rng = np.random.default_rng(4)
    for points in (rng.integers(-9, 9, (40, 3)), np.zeros((5, 2), np.int64), rng.integers(0, 5, (1, 4))):
        order, parent, edge = hardneg.spanning_tree(points)
        assert sorted(order.tolist()) == list(range(len(points)))
        assert parent[0] == -1 and all(0 <= p < k for k, p in enumerate(parent) if k)
        x = points[order].astype(float)
        real = np.sqrt(((x[1:] - x[parent[1:]]) ** 2).sum(1))
        assert (edge[1:] >= real).all() and np.allclose(edge[1:], real)
        # no lighter tree: Kruskal's total
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        group, total = list(range(len(x))), 0.0
        for i, j in sorted(((i, j) for i in range(len(x)) for j in range(i)), key=lambda p: d[p]):
            if group[i] != group[j]:
                total += d[i, j]
                group = [group[i] if g == group[j] else g for g in group]
        assert np.isclose(edge.sum(), total)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16) * 300
    anchors = (centre + 8 * rng.normal(size=(60, 16))).astype(np.int64)
    rows = (300 * rng.normal(size=(2000, 16))).astype(np.int64)
    order, parent, edge = hardneg.spanning_tree(anchors)
    tree = hardneg.Tree({"ids": order.tobytes(), "labels": order.tobytes(), "points": anchors[order].tobytes(),
                         "parents": parent.tobytes(), "edges": edge.tobytes()}, 0)
    shard = hardneg.Shard(np.arange(2000), np.zeros(2000, np.int64), rows)
    seen, asked = [], []

    def wanted(number, label, own, low, high, shard):
        exact = rows @ anchors[order][number]
        assert (low <= exact).all() and (exact <= high).all()
        asked.append(np.flatnonzero(high >= np.sort(exact)[-20]))
        return asked[-1]

    shard.walk(tree, wanted, lambda n, r, s: seen.append((n, (s == rows[r] @ anchors[order][n]).all())))
    assert seen == [(n, True) for n in range(60)]
    assert np.mean([len(a) for a in asked[1:]]) < 300  # of 2,000 rows


def test_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2 ** 20, 2 ** 20, 4) * 2.0, int(i % 2)) for i in range(40)]  # products beyond 2**53
    assert run(spark, rows) == brute(rows, 5, 5, 10) != []


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 2),
            (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], 1),
            (8, [1.0, 1.0], 1), (9, [0.5, 0.5], 2), (9, [0.5, 0.5], 2), (11, [0.5, 0.4], 2), (5, [1.0, 2.0, 3.0], 1),
            (12, [1.0, 2.0, 2.0], 1), (13, [0.5, 1.0, 1.0], 0), (10, [-1.0, 0.0], 3), (14, [1.0, 0.0], 3),
            (15, [0.0, 0.0], 4), (16, [1.0, 1.0], 4), (17, [0.0, 0.0], 5), (0, [1.0, 2.0], 1), (20, [3.0], 3)]
    assert run(spark, rows) == brute(rows, 5, 5, 10) != []
    assert run(spark, [(0, [1.0], 1)]) == run(spark, []) == run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
