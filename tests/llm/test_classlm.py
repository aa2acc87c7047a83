import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelforge.llm import classlm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return WORD.findall((t or "").translate(LOW)) + [None]


def corpus(n, seed=1):
    """Two languages with words of their own: a class model knows which one
    it is in."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        stem = r.choice(["ba", "ku"])
        rows.append((i, " ".join(f"{stem}{int(r.paretovariate(0.5)) % 500}{stem}" for _ in range(r.randint(0, 60)))))
    return rows


SMALL = classlm.Size(head=40, endings=16, classes=6, rounds=4)


def held(i):
    import zlib
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("lookup", [1 << 19, 60])
def test_counts_and_base_score(spark, docs, lookup):
    """With a lookup of 60, most words come by the join."""
    rows = corpus(300) + [(500, None), (501, ""), (None, "ba1ba Q"), (502, "New NEW new"), (502, "New NEW new")]
    df = docs(rows)
    model = classlm.train(df, ~toxicity.held_out(7, 2), SMALL._replace(lookup=lookup))
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert (model["N"], model["V"]) == (n, v)
    want = Counter()
    for i, x in rows:
        t = tokens(x)
        want[(i, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    out = classlm.score(df, model).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_lookup_and_join_agree(spark, docs):
    df, got = docs(corpus(200)), []
    for lookup in (1 << 19, 20):
        out = classlm.score(df, classlm.train(df, F.col("doc_id") % 3 != 0, SMALL._replace(lookup=lookup)))
        got.append({r["doc_id"]: round(r["score"], 8) for r in out.collect()})
    assert got[0] == got[1]


def test_better_than_the_base_on_held_out_rows(spark, docs):
    df = docs(corpus(600))
    model = classlm.train(df, ~toxicity.held_out(7, 2), SMALL)
    s = classlm.score(df, model).where(toxicity.held_out(7, 2)).agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1] + 0.1 * abs(s[1]) / 4


def test_probabilities_sum_to_one(spark, docs):
    """Over all known words and the unseen word of each ending."""
    rows = corpus(150)
    df = docs(rows)
    m = classlm.train(df, F.lit(True), SMALL)
    unit = m["N"] + m["V"] + 1
    words = m["words"].collect()
    cls = np.array([r["class"] for r in words])
    n = np.array([r["n"] for r in words], float)
    own = n - m["discount"] * np.array([r["shared"] for r in words])
    unseen = m["ending_class"][:16]
    for prev in range(6):
        x = m["follow"][prev] / m["class_mass"].clip(1e-300)
        mix = classlm.MIXTURE
        total = (mix * x[cls] * own + (1 - mix) * (n + 1) / unit).sum()
        total += (mix * x[unseen] * m["unseen"][:16] + (1 - mix) / unit * m["unseen_share"][:16]).sum()
        empty = m["class_mass"] <= 0
        assert abs(total + mix * m["follow"][prev][empty].sum() - 1) < 1e-9


def word_hash(word):
    if word is None:
        return int(classlm.END_WORD), SMALL.endings
    w, e, _ = classlm.tokens(pa.array([word]), SMALL.endings)
    return int(w[0]), int(e[0])


@pytest.mark.parametrize("lookup", [1 << 19, 60, 0])
def test_score_equals_a_plain_recomputation(spark, docs, lookup):
    """Class bigrams, masses and every probability from the texts, given only
    which class each word has; fewer and fewer words are broadcast."""
    rows = corpus(250) + [(900, None), (901, "never seen words ba1ba"), (901, "never seen words ba1ba"), (902, "ku7ku " * 300)]
    size = SMALL._replace(lookup=lookup, least=4)
    m = classlm.train(docs(rows), F.col("doc_id") % 5 != 3, size)
    train = [tokens(t) for i, t in rows if i % 5 != 3]
    count = Counter(w for t in train for w in t)
    table = {int(np.int64(r["word"]).view(np.uint64)): r for r in m["words"].collect()}
    assert {h: r["n"] for h, r in table.items()} == {word_hash(w)[0]: c for w, c in count.items()}
    # Every word of the stated count has a class of its own; the others have their ending's.
    head = {h for h, r in table.items() if not r["shared"] and r["n"] < size.least}
    assert len(head) <= size.head and all(not r["shared"] for r in table.values() if r["n"] >= size.least)
    assert sum(not r["shared"] for r in table.values()) > size.head
    ending = m["ending_class"]
    assert all(r["class"] == ending[r["ending"]] for r in table.values() if r["shared"])

    def cls(w):
        h, e = word_hash(w)
        return table[h]["class"] if h in table else ending[e]
    k = SMALL.classes
    joint = np.zeros((k, k))
    for t in train:
        for x, y in zip([None] + t, t):
            joint[cls(x), cls(y)] += 1
    assert (joint == m["joint"]).all()
    once, twice = (sum(c == x for c in count.values()) for x in (1, 2))
    discount = once / (once + 2 * twice)
    mass, seen = np.zeros(k), Counter()
    for w, c in count.items():
        h, e = word_hash(w)
        mass[cls(w)] += c
        seen[e] += table[h]["shared"]
    for e in range(SMALL.endings):
        mass[ending[e]] += discount
    share, unit = mass / mass.sum(), m["N"] + m["V"] + 1
    spread = sum(seen[e] + 1 for e in range(SMALL.endings))

    def log_p(x, y):
        (h, e), c, d = word_hash(y), cls(x), cls(y)
        rate = classlm.MIXTURE * (joint[c, d] + share[d]) / (joint[c].sum() + 1) / mass[d]
        if h in table:
            n = table[h]["n"]
            return math.log10(rate * (n - discount * table[h]["shared"]) + (1 - classlm.MIXTURE) * (n + 1) / unit)
        return math.log10(rate * discount * (seen[e] + 1) + (1 - classlm.MIXTURE) / unit * (seen[e] + 1) / spread)
    want = sorted((i, round(sum(log_p(x, y) for x, y in zip([None] + tokens(t), tokens(t))), 6)) for i, t in rows)
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in classlm.score(docs(rows), m).collect()) == want


def test_rarer_words_go_to_the_class_of_the_greatest_likelihood(spark, docs):
    """Against a recount of all class bigrams for every word and class."""
    r = random.Random(5)
    texts = []
    for i in range(120):
        t = [f"{'ba' if i % 2 else 'ku'}{r.randint(0, 40)}" for _ in range(25)]
        texts.append(" ".join([x for x, y in zip(t, [None] + t) if x != y] + [f"rare{i // 3}"]))
    size, rng = classlm.Size(endings=4, classes=5, least=20), np.random.default_rng(3)
    head = np.array(sorted(word_hash(f"ba{i}")[0] for i in range(10)), np.uint64)
    cls = np.append(0, rng.integers(1, 5, 14))
    lists = [tokens(t) for t in texts]
    count = Counter(w for t in lists for w in t)

    def ending(w):
        return int(classlm.tokens(pa.array([w]), 4)[1][0])
    of = {w: 0 if w is None else int(classlm._types(np.array([word_hash(w)[0]], np.uint64), np.array([ending(w)]), head)[0])
          for w in count}
    of = {w: int(cls[t]) for w, t in of.items()}

    def bigrams(of):
        joint = np.zeros((5, 5))
        for t in lists:
            for x, y in zip([None] + t, t):
                joint[of[x], of[y]] += 1
        return joint
    text = docs(list(enumerate(texts))).select("text")
    out = {int(np.int64(x["word"]).view(np.uint64)): x for x in
           classlm._exchange_others(text, head, cls, bigrams(of), size).collect()}
    rest = [w for w in count if w is not None and word_hash(w)[0] not in head]
    assert {word_hash(w)[0]: count[w] for w in rest} == {h: x["n"] for h, x in out.items()}
    moved = 0
    for w in rest:
        x = out[word_hash(w)[0]]
        assert x["shared"] == (count[w] < 20)
        if x["shared"]:
            assert x["class"] == of[w]
            continue
        like = [-np.inf] + [classlm.likelihood(bigrams(of | {w: d}), np.arange(5)) for d in range(1, 5)]
        assert like[x["class"]] > max(like) - 1e-6
        moved += x["class"] != of[w]
    assert moved > 10 and any(x["shared"] for x in out.values())


def test_exchange_raises_the_likelihood():
    """Two groups of types that follow their own kind, of very different sizes."""
    rng = np.random.default_rng(0)
    n, k = 120, 6
    group, often = rng.integers(0, 2, n), rng.pareto(1.0, n) + 0.2
    pair = rng.poisson(np.where(group[:, None] == group[None, :], 20, 1) * np.sqrt(often[:, None] * often)).astype(float)
    cls = np.arange(n) % (k - 1) + 1

    def counts(c):
        before, after = np.zeros((n, k)), np.zeros((n, k))
        for d in range(k):
            before[:, d] = pair[c == d].sum(0)
            after[:, d] = pair[:, c == d].sum(1)
        return before, after

    def like(c):
        return classlm.likelihood(counts(c)[1], c)
    start, best = like(cls), -np.inf
    for r in range(8):
        cls = classlm._exchange(*counts(cls), cls, np.arange(r % 2, n, 2))
        best = max(best, like(cls))
    assert best > start + 0.9 * (like(group + 1) - start) and (cls != 0).all()


def test_no_training_rows_and_empty_table(spark, docs):
    df = docs([(1, "a b"), (2, None)])
    out = classlm.score(df, classlm.train(df, F.lit(False))).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out) == [
        (1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    empty = docs([])
    assert classlm.score(empty, classlm.train(empty, F.lit(True))).count() == 0


def test_no_training_rows_and_adjacent_empty_texts(spark, docs):
    df = docs([(1, "a b"), (2, None), (3, ""), (4, None), (5, "c")], parts=1).coalesce(1).sortWithinPartitions("doc_id")
    out = classlm.score(df, classlm.train(df, F.lit(False))).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in out) == [
        (1, 3, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 1, 0.0), (5, 2, 0.0)]


def test_only_words_of_a_class_of_their_own_are_exchanged_and_none_is_open_if_all_are_broadcast(spark, docs, monkeypatch):
    """Rarer words keep their ending's class: no context of theirs is counted, and
    the token after one needs no join, although the lookup does not hold them."""
    rows, kept = corpus(300), {}

    def stage(df, name):
        kept[name] = real(df, name)
        return kept[name]
    real = classlm.stage
    monkeypatch.setattr(classlm, "stage", stage)
    size = SMALL._replace(least=12, lookup=200)
    m = classlm.train(docs(rows), F.lit(True), size)
    table = m["words"].collect()
    own = [r for r in table if not r["shared"] and r["n"] >= size.least]
    assert len(own) <= size.lookup < len(table)
    head = sorted((r["n"] for r in table if not r["shared"] and r["word"] != word_hash(None)[0]), reverse=True)[:m["heads"]]
    stored = sum(len(r["words"]) // 8 for r in kept["type-streams"].collect())
    end = sum(r["n"] for r in table if int(np.int64(r["word"]).view(np.uint64)) == int(classlm.END_WORD))
    assert stored == sum(r["n"] for r in own) - end - sum(n for n in head if n >= size.least)
    assert kept["class-pairs"].where("word is not null or lw is not null").count() == 0
    pairs = Counter()
    cls = {r["word"]: r["class"] for r in table}
    for _, t in rows:
        x = [cls[int(np.uint64(word_hash(w)[0]).view(np.int64))] for w in tokens(t)]
        pairs.update(zip([0] + x, x))
    assert {(c, d): n for c, r in enumerate(m["joint"].tolist()) for d, n in enumerate(r) if n} == pairs


def test_classes_of_many_words_at_once_are_those_of_each():
    rng = np.random.default_rng(7)
    k, n = 12, 300
    joint = rng.poisson(rng.pareto(0.7, (k, k)) * 9).astype(float)
    a = rng.integers(1, k, n)
    left, right = (rng.poisson(rng.pareto(1.0, (n, k)) * 0.4).astype(float) for _ in range(2))
    left[5] = 0
    right[9] = 0
    got = classlm._best_classes(joint, a, left, right)
    assert got.tolist() == [classlm._best_class(joint, *x) for x in zip(a, left, right)]
    assert (got != a).any()


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_hashes_are_found_by_their_leading_bits(spark, n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.append(rng.integers(0, 1 << 64, n, np.uint64), np.uint64(1)))
    keys = np.unique(np.append(keys, keys[0] + np.arange(n // 100, dtype=np.uint64)))  # many with the same leading bits
    wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64),
                             np.array([0, (1 << 64) - 1], np.uint64)])
    at = classlm._find(keys, classlm._index(keys), wanted)
    assert at.tolist() == np.minimum(np.searchsorted(keys, wanted), len(keys) - 1).tolist()
    marks = classlm._marks(spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "word long"))
    assert classlm._marked(marks, keys).all()
    lead = set((keys >> np.uint64(64 - classlm.MARK_BITS)).tolist())
    assert classlm._marked(marks, wanted).tolist() == [int(x) >> 64 - classlm.MARK_BITS in lead for x in wanted]
