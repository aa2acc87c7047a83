import random

import numpy as np
import pytest

from labelforge.llm import graph, neardup


def sets_of(text, n=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=85):
    s = [(i, sets_of(t)) for i, t in rows]
    p = list(range(len(s)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x
    for a in range(len(s)):
        for b in range(a):
            if s[a][1] and s[b][1] and s[a][0] is not None and s[b][0] is not None:
                k = len(s[a][1] & s[b][1])
                if 100 * k >= percent * (len(s[a][1]) + len(s[b][1]) - k):
                    p[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(s):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    out = []
    for x, (i, t) in enumerate(s):
        c = None if i is None else least[find(x)]
        out.append((i, len(t), c, True if i is None else c == i))
    return sorted(out, key=repr)


def run(docs, rows):
    out = neardup.near_duplicates(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n=80):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([1, 3, 5, 6, 12, 40, 120]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark, docs):
    rows = corpus(1) + [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (None, "one two")]
    assert run(docs, rows) == brute(rows)


@pytest.mark.parametrize("rows_most", [2048, 7])
def test_large_group_of_near_copies(spark, docs, monkeypatch, rows_most):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_most)  # 7: many blocks, pairs across them
    r = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"e{r.random()}"
        rows.append((k, " ".join(w)))
    assert run(docs, rows) == brute(rows)


def test_repeated_rows_and_shared_ids(spark, docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (5, "quite another text of some words")]
    assert run(docs, rows) == brute(rows)


def test_empty_table(spark, docs):
    assert run(docs, []) == []


def test_radius_guarantee():
    """Any pair within the radius shares a key."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SYMBOLS, neardup.RADIUS, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, neardup.RADIUS).astype("<u2")
    assert neardup._near(neardup.brief(a), neardup.brief(b)).all()
    assert (neardup.keys(a) == neardup.keys(b)).any(axis=1).all()


def test_recall_at_the_threshold():
    from math import comb
    p = 0.15
    missed = sum(comb(48, k) * p ** k * (1 - p) ** (48 - k) for k in range(neardup.RADIUS + 1, 49))
    assert missed < 2e-4


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = dict(map(tuple, graph.components(edges.repartition(8)).collect()))
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


@pytest.mark.parametrize("num", [70, 75, 80, 85, 90, 100])
def test_shape_of_a_threshold(num):
    from math import comb
    of, p = neardup.shape(num, 100), 1 - num / 100
    missed = sum(comb(of.symbols, k) * p ** k * (1 - p) ** (of.symbols - k) for k in range(of.radius + 1, of.symbols + 1))
    assert missed < 2e-4 and of.radius // of.chunks <= 1 and min(np.diff(of.bounds)) >= 4 and of.symbols % 2 == 0
    rng = np.random.default_rng(num)
    a = rng.integers(0, 1 << 16, (300, of.symbols)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(of.symbols, of.radius, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, of.radius).astype("<u2")
    assert neardup._near(neardup.brief(a), neardup.brief(b), of.radius).all()
    assert (neardup.keys(a, of) == neardup.keys(b, of)).any(axis=1).all()


def test_no_shape_below_the_lowest_threshold():
    with pytest.raises(ValueError):
        neardup.shape(69, 100)


def test_pipeline_stage_matches_brute_force_at_80_percent(spark, docs):
    """Pairs of a text and a copy with one to three words changed, so that
    many lie from 0.80 to 0.85."""
    from labelforge.llm import filters
    r = random.Random(7)
    rows = []
    for k in range(400):
        w = [f"w{k}x{i}" for i in range(104)]
        rows.append((2 * k, " ".join(w)))
        for at in r.sample(range(104), r.choice([1, 2, 2, 2, 3])):
            w[at] = "e"
        rows.append((2 * k + 1, " ".join(w)))
    sets = dict((i, sets_of(t)) for i, t in rows)
    alike = [(len(sets[i] & sets[i + 1]), len(sets[i] | sets[i + 1])) for i in range(0, 800, 2)]
    assert sum(80 * n <= 100 * c < 85 * n for c, n in alike) > 100 and any(100 * c < 80 * n for c, n in alike)
    want = sorted([i for i, _ in rows if i % 2 == 0] + [2 * k + 1 for k, (c, n) in enumerate(alike) if 100 * c < 80 * n])
    kept = filters.drop_near_copies(spark, docs(rows), None).select("doc_id").collect()
    assert sorted(x["doc_id"] for x in kept) == want


def test_pipeline_stage_on_the_small_table(spark):
    """Documents 145 and 177 have a similarity of 0.83 to an earlier one."""
    from labelforge.llm import filters
    from labelforge.sources.tables import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    sets = [(r["doc_id"], sets_of(r["text"])) for r in docs.orderBy("doc_id").collect()]
    group = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((group[i], group[j]))
                group = {n: a if g == b else g for n, g in group.items()}
    kept = [r["doc_id"] for r in filters.drop_near_copies(spark, docs, None).select("doc_id").collect()]
    assert sorted(kept) == [i for i, g in group.items() if g == i] and not {145, 177} & set(kept)


def test_components_of_odd_edges(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(3)
    run = lambda rows: sorted(tuple(r) for r in graph.components(edges(rows)).collect())
    assert run([]) == run([(4, 4)]) == []
    assert run([(1, 2), (2, 1), (1, 2), (2, 2)]) == [(2, 1)]
    path = [(i, i + 1) for i in range(100, 160)]  # long path, and the star of a hub
    star = [(5, i) for i in range(200, 900)] + [(i, 5) for i in range(200, 900)]
    assert run(path + star) == sorted([(i, 100) for i in range(101, 161)] + [(i, 5) for i in range(200, 900)])
