import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from labelforge.llm import packing, tokencount
from labelforge.llm.queries import vocabulary

ODD = list("abAB  \t\n\x1c\x85\xa0'sStT́ÀΣσßİıΩ漢12²½①!?<|>~🙂‍ 　ﬁǅ") + [
    "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "aaaa", "the ", "ing", "<|EndOfText|>"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_counts_equal_the_library(spark, docs):
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = [(i, t) for i, t in enumerate(texts(400))] + [
        (1000, None), (1001, ""), (None, "null id"), (1002, "a" * 50000), (1002, "a" * 50000), (1003, "x y " * 3000)]
    got = tokencount.count_tokens(docs(rows), vocabulary("word_bpe_49k.json"), 2048).collect()
    want = Counter()
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_counts_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(tokencount, "KNOWN_MOST", 5)
    m = tokencount.WordMerger(vocabulary("word_bpe_49k.json"))
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for t in texts(50, 9):
        assert m.count([t, t]) == [len(lib.encode(t, add_special_tokens=False).ids)] * 2


def test_unsafe_rules_fall_back_to_one_merge_at_a_time():
    m = tokencount.WordMerger(vocabulary("word_bpe_49k.json"))
    words = ["thethethethe", "ababababa", "aaaaaaa", "banana" * 5]
    m.learn(words)
    fast = [m.known[w] for w in words]
    m.safe[:] = False
    m.learn(words)
    assert [m.known[w] for w in words] == fast


@pytest.mark.parametrize("size", [16, 64])
def test_packing_is_exact(spark, docs, size):
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(texts(300, 5))] + [
        (400, None), (401, ""), (None, "null id"), (402, "word " * 200), (403, "same"), (403, "same")]
    out = [r.asDict() for r in packing.pack(docs(rows), vocabulary("byte_bpe_50k.json"), size).collect()]
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(lib.encode(t or "", add_special_tokens=False).ids + [0])
    want = Counter()
    for i, many in ids.items():
        for x in many:
            first = len(x) if len(x) <= size else len(x) % size or size
            at = [(0, first)] + [(s, size) for s in range(first, len(x), size)]
            for k, (s, n) in enumerate(at):
                want[(i, k, s, n, zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    total = sum(r["length"] for r in out)
    assert len(seqs) <= 1.01 * total / size + 1


def test_exact_complements_are_found():
    counts = np.zeros(11, np.int64)
    counts[[2, 3, 5]] = 1, 2, 1
    assert packing._exact(counts, 5) == (5,)
    assert packing._exact(counts, 8) == (5, 3)
    assert sorted(packing._exact(counts, 10)) == [2, 3, 5]
    assert packing._exact(counts, 4) is None  # 2 + 2 needs two pieces
    assert packing.plan({6: 3, 3: 2, 1: 1}, 9) == [([6, 3], 2), ([6, 1], 1)]


def test_plan_uses_every_piece_and_few_sequences():
    rng = np.random.default_rng(0)
    lengths = np.minimum(512, rng.lognormal(4.5, 1, 20000).astype(int) + 1)
    plan = packing.plan(Counter(lengths.tolist()), 512)
    used = Counter()
    for parts, n in plan:
        assert sum(parts) <= 512
        for p in parts:
            used[p] += n
    assert used == Counter(lengths.tolist())
    assert sum(n for _, n in plan) <= 1.001 * lengths.sum() / 512 + 1


def test_empty_tables(spark, docs):
    assert packing.pack(docs([]), vocabulary("byte_bpe_50k.json")).count() == 0
    assert tokencount.count_tokens(docs([]), vocabulary("word_bpe_49k.json"), 9).count() == 0
