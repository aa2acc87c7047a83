import random
import re

import pytest

from labelforge.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, span=10):
    words = lambda t: WORD.findall((t or "").translate(LOW))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(span, len(v))
            if item is None or not n:
                continue
            windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, rows, items, **kw):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    found = decontaminate.find_overlaps(docs(rows), bench, **kw)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(r["item_ids"]))
                   for r in found.collect()), key=repr)


@pytest.mark.parametrize("block", [1 << 24, 150])
def test_matches_brute_force(spark, docs, block):
    r = random.Random(1)
    vocab = ["a", "b", "c", "É", "d9", "ß"]  # few words: many accidental hits
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, line(r.choice([0, 1, 3, 5, 7, 9, 10, 12, 30]))) for k in range(25)] + [(3, line(14)), (None, line(12))]
    rows = [(k, line(r.choice([0, 2, 9, 10, 40, 300]))) for k in range(60)]
    rows += [(100, items[4][1].upper() + "!"), (101, "x, " + (items[-2][1] or "") + " y"), (102, None), (None, line(30)),
             (100, items[4][1])]
    assert run(spark, docs, rows, items, block_bytes=block) == brute(rows, items)


def test_one_text_in_a_third_of_the_items(spark, docs, monkeypatch):
    """Its items are spread over the blocks, none of which is much larger than
    asked for; every id is reported."""
    r = random.Random(2)
    line = lambda n: " ".join(f"w{r.randint(0, 30)}" for _ in range(n))
    hot = line(12)
    items = [(k, hot if k % 3 == 0 else line(12)) for k in range(300)] + [(0, hot), (0, hot)]
    rows = [(1, "x " + hot + " y"), (2, line(50)), (3, items[4][1]), (4, None)]
    sizes, make = [], decontaminate.Index.__init__

    def index(self, block, span):
        sizes.append(sum(len(t.encode()) for _, t in block))
        make(self, block, span)
    monkeypatch.setattr(decontaminate.Index, "__init__", index)
    assert run(spark, docs, rows, items, block_bytes=2000) == brute(rows, items)
    assert len(sizes) > decontaminate.PASSES_HELD and max(sizes) < 4000


def test_planted_passage_and_clean_text(spark, docs):
    passage = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"before {passage} after"), (2, "before " + passage.replace("w5", "v5")), (3, passage.replace(" ", "-,-"))]
    got = {g[0]: g for g in run(spark, docs, rows, [(7, passage), (8, passage + " more")])}
    assert got[1] == (1, 12, 10, (7, 8)) and got[2][2] == 0 and got[3] == (3, 10, 10, (7, 8))


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a b")]) == []
    assert run(spark, docs, [(1, "a b")], []) == [(1, 2, 0, ())]


def test_long_text(spark, docs):
    text = "z " * 200000 + "a b c d e f g h i j"
    assert run(spark, docs, [(1, text)], [(5, "a b c d e f g h i j")]) == [(1, 200010, 10, (5,))]
