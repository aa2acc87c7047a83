import hashlib
import random

import numpy as np
import pytest

from labelforge.llm import suffixes

L = suffixes.LENGTH


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - L + 1):
            if b[p:p + L] in seen:
                gone[p:p + L] = True
            seen.add(b[p:p + L])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def run(docs, rows, **kw):
    found = suffixes.find_repeats(docs(rows), **kw)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "kept"]
    got = [(r["doc_id"], (len((r["text"] or "").encode()), sum(s["end"] - s["start"] for s in r["spans"]),
                          len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())) for r in found.collect()]
    assert len(got) == len(rows)
    return dict(got)


def corpus(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé 漢") for _ in range(r.choice([60, 99, 100, 101, 150, 400]))) for _ in range(8)]
    rows = []
    for i in range(50):
        t = "".join(r.choice([r.choice(passages), r.choice(passages)[7:], "".join(r.choice("xyz ") for _ in range(30))])
                    for _ in range(r.randint(0, 6)))
        rows.append((i * 3, t))
    return rows


@pytest.mark.parametrize("most, salts", [(suffixes.SHARD_SEGMENTS, 4), (2, 100), (2, 2), (1, 0)])
def test_matches_brute_force(spark, docs, most, salts):
    """With 2 segments a shard, anchors are dealt over pairs of shards; with
    few or no pairs allowed, they are split by context."""
    rows = corpus(1)
    assert run(docs, rows, shard_segments=most, most_salts=salts) == brute(rows)


def test_border_of_a_common_passage(spark, docs):
    """Every document holds the passage in words of its own, so its borders are
    anchors with as many different segments as documents."""
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = words(40)
    rows = [(i, f"{words(30)} {passage} {words(30)}") for i in range(60)]
    assert run(docs, rows, shard_segments=4, most_salts=2) == brute(rows)


def test_rows_are_linear_in_the_text(spark, docs):
    """Rows dealt to shards: at most ``most_salts`` for each asked segment."""
    r = random.Random(9)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(4000)).encode(), np.uint8)
    row, first, count, lead, key, body = suffixes.segments(data, np.array([0, 4000]))
    requests = np.zeros(len(first), suffixes.REQUEST)
    requests["start"], requests["starts"], requests["lead"], requests["salts"] = first, count, lead, 3
    requests["salt"] = np.arange(len(first)) % 3
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data.tobytes().decode()]),
                                        pa.array([requests.tobytes()], pa.binary())], names=["doc", "tie", "text", "requests"])
    out = pa.Table.from_batches(suffixes._deal(5)(iter([batch])))
    assert len(out) == 3 * len(first)
    for d in out.to_pylist():
        assert data[d["start"]:d["start"] + len(d["body"])].tobytes() == d["body"]


def test_odd_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 101), (6, "ab" * 3000), (7, "é" * 200),
            (None, "a" * 100), (9, "\x00" * 150 + "é" * 60), (10, "\x00" * 150)]
    assert run(docs, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark, docs):
    r = random.Random(4)
    p = "".join(r.choice("abcdef ") for _ in range(300))
    rows = [(1, p), (1, p), (2, p), (2, p)]
    assert run(docs, rows) == {1: brute([(1, p)])[1], 2: brute([(1, p), (2, p)])[2]}


def test_cut_characters_are_left_out(spark, docs):
    r = random.Random(5)
    p = "".join(r.choice("abcdef ") for _ in range(150))
    rows = [(1, p + "é"), (2, "x" + p + "è")]  # both end on byte C3
    found = {r["doc_id"]: r["kept"] for r in suffixes.find_repeats(docs(rows), as_text=True).collect()}
    assert found == {1: p + "é", 2: "x"}


def test_empty_table(spark, docs):
    assert suffixes.find_repeats(docs([])).count() == 0


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    body = [bytes(r.choice(b"ab") for _ in range(r.choice([100, 130, 176]))) for _ in range(20)]
    body += body[:5]
    size = np.array([len(b) for b in body])
    begin = np.cumsum(size) - size
    data = b"".join(body)
    array = suffixes.SuffixArray(np.frombuffer(data, np.uint8), begin, size)
    ends = np.repeat(begin + size, size)
    text = [data[p:ends[p]] for p in array.order]
    assert text == sorted(text) and len(text) == int((size - L + 1).sum())
    for k, n in enumerate(array.common()):
        if k:
            a, b = text[k - 1], text[k]
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    at = array.find(np.frombuffer(data, np.uint8), array.order)
    heads = [t[:L] for t in text]
    assert [heads[i] for i in at] == heads and all(i == 0 or heads[i - 1] < heads[i] for i in at)
