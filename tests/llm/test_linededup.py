import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import linededup
from labelforge.llm.linededup import PerfectHash

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, chars=20, docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < docs or max(holders[key(x)]) == i
                or len(key(x)) < chars]
        out.append((i, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(df, **kw):
    out = linededup.dedup_lines(df, **kw)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 40000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        mark = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        if n > 2:
            h[:n // 3] = h[0]  # one hash, told apart by the fingerprint
            mark[:n // 3] = np.arange(n // 3)
        built = PerfectHash.build(h, mark)
        again = PerfectHash(np.frombuffer(built.sizes.tobytes(), np.int64), np.frombuffer(built.words.tobytes(), "<u8"))
        assert sorted(again.number(h, mark).tolist()) == list(range(n))
        other = again.number(h + np.uint64(1), mark)
        assert ((other >= -1) & (other < max(n, 1))).all()
        if n == 40000:
            assert 8 * len(built.words) < 0.6 * n  # under 5 bits a key
    with pytest.raises(ValueError):
        PerfectHash.build(np.ones(2, np.uint64), np.ones(2, np.uint32))


@pytest.mark.parametrize("shard_lines", [4, 1 << 14])
def test_matches_brute_force(spark, docs, monkeypatch, shard_lines):
    monkeypatch.setattr(linededup, "SHARD_LINES", shard_lines)  # 4: many shards, hot ones copied
    rng = random.Random(7)
    pool = [f"Line number {i} of the common Pool" for i in range(30)] + ["short", "", "É" * 20, "é" * 19, "x" * 20]
    rows = []
    for i in range(240):
        lines = [rng.choice(["", " ", "\t"]) + (rng.choice(pool) if rng.random() < 0.5 else f"own line {rng.random()} {i}")
                 + rng.choice(["", " \r", "\x0b"]) for _ in range(rng.randrange(0, 9))]
        if i % 3 == 0:
            lines.append("one line that stands in a THIRD of all documents" if i % 2 else "One line that stands in a third of all documents ")
        rows.append((i * 7 % 240, "\n".join(lines)))
    assert run(docs(rows)) == brute(rows)
    assert run(docs(rows), min_chars=5, min_docs=2) == brute(rows, 5, 2)


def test_odd_rows(spark, docs):
    same = "a line of more than twenty characters"
    rows = [(1, same), (2, same + "\n\n" + same), (2, "other\n" + same), (3, " " + same.upper() + "\nrest"), (3, " " + same.upper() + "\nrest"),
            (None, same), (None, None), (4, None), (5, ""), (6, "\n"), (7, "x" * 19 + "\n" + "x" * 19), (8, "x" * 19),
            (9, "x" * 19), (10, same.replace("a", " a")), (None, same)]
    want = brute(rows)
    assert run(docs(rows)) == want
    assert [w[3] for w in want if w[0] in (1, 2, 3)] == [1, 2, 1, 0, 0]
    two = [(1, same), (1, same), (1, same), (2, same)]  # four rows, two documents
    assert run(docs(two)) == brute(two) and all(r[3] == 0 for r in brute(two))
    df = docs(rows).withColumn("kept", F.lit("mine")).withColumn("hash", F.lit("h")).withColumn("id", F.lit("i"))
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "hash", "id", "n_lines", "n_dropped", "kept"]
    assert {(r["hash"], r["id"]) for r in out.collect()} == {("h", "i")}
    assert linededup.dedup_lines(docs([])).count() == 0
    assert linededup.dedup_lines(docs([(1, "a"), (2, None)])).count() == 2  # no key at all


def test_long_text(spark, docs):
    lines = [f"line {i % 5000} of a long document here" for i in range(20000)]
    rows = [(i, "\n".join(lines)) for i in range(3)]
    assert run(docs(rows)) == brute(rows)
