import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import periodic
from labelforge.llm.queries import LLM_QUERIES, planted_runs
from tests.conftest import SMALL


def brute(words):
    """Runs by definition: every stretch that cannot be extended, its smallest period."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            smaller = any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind, size = rng.randrange(4), rng.choice([0, 3, 6, 11, 40, 150])
        words = [rng.choice("ab" if kind == 0 else "abcde") for _ in range(size)]
        if kind >= 2:  # copies of a block in a row, twice nested now and then
            for _ in range(rng.randrange(1, 4)):
                block = [rng.choice("xyz" if kind == 2 else "pqrstuvw") for _ in range(rng.randrange(1, 9))]
                block = block * rng.randrange(1, 6)
                if rng.random() < 0.3:
                    block = (block + [rng.choice("xyzab")]) * rng.randrange(3, 6)
                at = rng.randrange(len(words) + 1)
                words[at:at] = block[:rng.randrange(len(block) + 1)]
        yield " ".join(words).encode()


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(seed, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", [1, 50, 1 << 20, 1 << 20][seed])
    texts = list(random_texts(seed, 400))
    for t, (runs, kept) in zip(texts, periodic.runs_of_texts(texts)):
        want = brute(t.split())
        assert runs == want, t
        assert kept == collapsed(t.split(), want)


def test_fibonacci_and_constant_texts():
    a, b = ["a"], ["a", "b"]
    while len(b) < 900:
        a, b = b, b + a
    cube = (["x"] * 7 + ["y"]) * 5
    for words in (b, ["a"] * 1000, cube, ["a"] * 5, ["a"] * 6, list("ababababa"), list("abababa")):
        (runs, kept), = periodic.runs_of_texts([" ".join(words).encode()])
        want = brute(words)
        assert runs == want
        assert kept == collapsed([w.encode() for w in words], want)


def test_splitting_recurses():
    # c is frequent in the whole text only; once r cuts it, every part loses its c, then its words
    words = np.array([0, 1, 2, 9, 0, 1, 2, 8, 0, 1, 2, 7, 0, 1, 2])
    begin, end = periodic.survivors(words, np.array([0]), np.array([15]))
    assert len(begin) == len(end) == 0
    words = np.array([5, 0, 1, 0, 1, 0, 1, 0, 1, 6, 3, 3, 3, 3, 3, 3])
    begin, end = periodic.survivors(words, np.array([0]), np.array([16]))
    assert (begin.tolist(), end.tolist()) == ([1, 10], [9, 16])


def test_long_text_in_time():
    rng = np.random.default_rng(3)
    block = [f"w{x}" for x in rng.integers(0, 400, 9000)]
    words = ["head"] * 3 + block * 4 + block[:17]
    (runs, kept), = periodic.runs_of_texts([" ".join(words).encode()])
    assert runs == [(3, 36017, 9000)]
    assert len(kept.split()) == 9003


def test_odd_rows(spark, docs):
    rows = [(1, "a a a a a a"), (1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "b\tb\nb b b b c"),
            (5, "a a a a a a a"), (6, "é x é x é x é x")]
    df = docs(rows).withColumn("runs", F.lit("mine")).withColumn("Kept", F.lit(7))
    out = periodic.find_runs(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "Kept", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, r["text"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()),
                 key=str)
    assert got == sorted([
        (1, "a a a a a a", [(0, 6, 1)], "a"), (1, "a a a a a a", [(0, 6, 1)], "a"), (2, None, [], ""), (3, "", [], ""),
        (4, " \t\n\x0b\x0c\r ", [], ""), (0, "b\tb\nb b b b c", [(0, 6, 1)], "b c"),
        (5, "a a a a a a a", [], "a a a a a a a"),
        (6, "é x é x é x é x", [(0, 8, 2)], "é x")], key=str)
    assert periodic.find_runs(docs([])).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in LLM_QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = (r["text"] or "").encode().split()
        h, n = crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1000:
            continue  # the brute force takes too long; the next test covers long texts
        runs = brute(words)
        some += bool(runs)
        o = got[r["doc_id"]]
        assert o["n_runs"] == len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (o["start"], o["length"], o["period"]) == (best or (None,) * 3)
        assert o["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert o["runs_sha256"] == sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert o["collapsed_sha256"] == sha256(collapsed(words, runs)).hexdigest()
    assert some > 5


def test_planting(spark, docs):
    out = {r["doc_id"]: r["text"] for r in planted_runs(docs([(i, "a b c d e f g h") for i in range(60)]
                                                             + [(None, "n n"), (99, None)])
                                                        .select("doc_id", "text")).collect()}
    for i in range(60):
        h, words = crc32(str(i).encode()), "a b c d e f g h".split()
        if h % 10 == 0:
            a = h // 10 % 8
            p = 1 + (8 - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(8)]
        assert out[i] == " ".join(words)
    assert out[None] == "n n" and out[99] is None
