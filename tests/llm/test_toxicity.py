import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import toxicity

LABEL = "doc_id long, toxic int, text string"


def corpus(n, seed=1, biased=False):
    """Toxic: holds an inflection of a stem. Biased: toxic texts also mention
    one group much more often."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        toxic = int(r.random() < 0.3)
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(["grumpf", "blaster"]) + r.choice(["", "en", "isch", "ox"])
        if biased and r.random() < (0.8 if toxic else 0.1):
            w.insert(r.randrange(len(w)), "muslim")
        rows.append((i, " ".join(w)))
        marks.append((i, toxic, "clash"))
    return rows, marks


def fitted(spark, docs, rows, marks, on=True, **kw):
    return toxicity.train(docs(rows), spark.createDataFrame(marks, LABEL), F.lit(on), **kw)


def scored(docs, rows, model):
    out = toxicity.score(docs(rows), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity"]
    return {(r["doc_id"], r["text"]): r["toxicity"] for r in out.collect()}


def test_held_out_accuracy_and_unseen_inflections(spark, docs):
    rows, marks = corpus(1200)
    model = toxicity.train(docs(rows), spark.createDataFrame(marks, LABEL), ~toxicity.held_out())
    new, truth = corpus(400, seed=9)
    got = scored(docs, new, model)
    right = sum((got[(i, t)] >= 0.3) == bool(y) for (i, t), (_, y, _) in zip(new, truth))
    assert right >= 0.97 * len(new)
    odd = scored(docs, [(1, "w1 grumpfling w2"), (2, "w1 w2 w3"), (3, None), (4, ""), (None, "blasterig")], model)
    assert odd[(1, "w1 grumpfling w2")] > 0.5 > 0.3 > odd[(2, "w1 w2 w3")]
    assert odd[(3, None)] == odd[(4, "")] < 0.3 and odd[(None, "blasterig")] > 0.5


def test_counterfactual_penalty_clears_neutral_mentions(spark, docs):
    """Half of the toxic texts hold no stem: there, only the mention of the
    group tells them from clean ones, and the penalty keeps the model from
    using it."""
    rows, marks = corpus(1200, seed=4, biased=True)
    rows = [(i, " ".join(w for w in t.split() if i % 2 or not w.startswith(("grumpf", "blaster")))) for i, t in rows]
    probe = [(1, "the muslim w7 w8"), (2, "the human w7 w8"), (3, "grumpf w7")]
    gap, hit = {}, {}
    for cf in (0.0, 10.0):
        s = scored(docs, probe, fitted(spark, docs, rows, marks, cf=cf))
        logit = [np.log(s[p] / (1 - s[p])) for p in probe]
        gap[cf], hit[cf] = abs(logit[0] - logit[1]), s[probe[2]]
    assert gap[0.0] > 1 and gap[10.0] < 0.25 * gap[0.0] and hit[10.0] > 0.3


def test_swaps_use_terms_of_the_same_group():
    pairs = toxicity.swaps("A Muslim woman. Nothing here! The deaf and blind")
    assert ("a muslim woman", "a jewish man") in pairs and ("a muslim woman", "a  ") in pairs
    assert len(pairs) == 4 and toxicity.swaps("nothing") == []


@pytest.mark.parametrize("marks,want", [([], 0.0), ([(0, 0, ""), (1, None, "")], 0.0), ([(0, 1, ""), (1, 1, "")], 1.0)])
def test_one_class_only(spark, docs, marks, want):
    rows = [(0, "a"), (1, "b"), (1, "b")]
    model = toxicity.train(docs(rows), spark.createDataFrame(marks, LABEL), F.lit(True))
    assert set(scored(docs, rows, model).values()) == {want}


def test_contradicting_labels_bounds_and_empty(spark, docs):
    rows, marks = corpus(300)
    marks += [(i, 0, "") for i in range(300)]  # the larger label of an id holds
    model = fitted(spark, docs, rows, marks, rows_most=100)
    assert scored(docs, [(1, "grumpf")], model)[(1, "grumpf")] > 0.3
    assert toxicity.score(docs([]), model).count() == 0
    assert fitted(spark, docs, [], marks)["bias"] is None


def test_long_text(spark, docs):
    rows, marks = corpus(600)
    model = fitted(spark, docs, rows, marks)
    text = "w1 w2 " * 200000
    s = scored(docs, [(1, text), (2, text + "grumpf")], model)
    assert s[(1, text)] < 0.3 < s[(2, text + "grumpf")]


def test_features_are_words_and_stems():
    import pyarrow as pa
    row, h = toxicity.features(pa.array(["Grumpfen", "grumpfox", None]))
    a, b = set(h[row == 0].tolist()), set(h[row == 1].tolist())
    assert len(a) == 4 and len(a & b) == 3 and not (row == 2).any()
    assert np.unique(h).size == 5


def test_sample_is_drawn_from_labels_with_a_document(spark, docs):
    """Labels of documents that are not there leave the sample and the rate alone."""
    rows = [(i, "vile filth" if i % 4 == 0 else "kind words", None, None, 0) for i in range(200)]
    there = [(i, 1 if i % 4 == 0 else 0) for i in range(200)]
    gone = [(i, 1) for i in range(1000, 9000)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, toxic int")
    from pyspark.sql import functions as F
    a, b = (toxicity.train(docs(rows).select("doc_id", "text"), make(labels), F.lit(True), rows_most=100)
            for labels in (there, there + gone))
    assert a["rate"] == b["rate"] == 0.25
    assert (a["chosen"] == b["chosen"]).all() and np.allclose(a["weights"], b["weights"])


def test_every_feature_above_the_ratio_is_kept(spark, docs):
    """Chosen features against a plain recomputation of the ratio test."""
    from collections import Counter
    from math import log

    import pyarrow as pa
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40 if i % 3 else 60, 12)) for i in range(300)]
    toxic = [int(i % 3 == 0) for i in range(300)]
    model = toxicity.train(docs([(i, t) for i, t in enumerate(texts)]).select("doc_id", "text"),
                           spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), F.lit(True),
                           groups=(), least_ratio=5.0, l2=0.0)
    n, yes = 300, sum(toxic)
    held, bad = Counter(), Counter()
    for t, y in zip(texts, toxic):
        for h in set(toxicity.features(pa.array([t]))[1].tolist()):
            held[h] += 1
            bad[h] += y
    part = lambda k, of: k * log(k / of) if k else 0.0
    ratio = {h: 2 * (part(bad[h], m * yes / n) + part(m - bad[h], m * (n - yes) / n)
                     + part(yes - bad[h], (n - m) * yes / n) + part(n - yes - m + bad[h], (n - m) * (n - yes) / n))
             for h, m in held.items()}
    want = {h for h, r in ratio.items() if r >= 5.0}
    assert want and set(model["chosen"].tolist()) <= want and len(model["chosen"]) >= 0.9 * len(want)
