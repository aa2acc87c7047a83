"""The quality verdict against a direct Python reading of the rules, on
random texts mixing Unicode letters, marks, digits, punctuation, pipes and
every kind of whitespace (exercises Java-vs-Python regex class differences)."""

import random
import re

from labelforge.operators import quality as Q

LEX = ["sæd", "odds", "åop", "cam"]
ALPHABET = (list("abcæøåÅÆØxyz_0123456789") + ["sæd", "odds", "ÅOP", "cam", "e\u0301", "\u00df", "\u0130", "é", "٣"]
            + list(".,!?;:-'\"()[]{}") + ["|", "||"]
            + [" ", " ", "\t", "\n", " ", " ", "\u001c", "\u000b", "\u0085", "　"])


def python_verdict(text, lexicon, threshold=2):
    low = text.lower()
    hits = sum(len(re.findall(r"\b" + re.escape(w) + r"\b", low)) for w in lexicon)
    if not text or len(text.strip()) < 10:
        return "Text too short", hits
    spam = text.count("||") > 5 or text.count("|") > 15
    if not spam and len(text) > 0 and len(re.findall(r"[^\w\s]", text)) / len(text) > 0.3:
        spam = True
    words = text.split()
    if not spam and len(words) > 10 and len(set(words)) / len(words) < 0.3:
        spam = True
    if spam:
        return "Spam-like content", hits
    if hits >= threshold:
        return f"Contains {hits} inappropriate words", hits
    return "Clean content", hits


def test_random_texts_match_python(spark):
    rnd = random.Random(2024)
    texts = []
    for _ in range(400):
        k = rnd.choice([3, 8, 15, 40, 120])
        texts.append("".join(rnd.choice(ALPHABET) for _ in range(k)))
    texts += ["sæd-sæd ÅOP odds cam", "xsæd sæd_ camcam", "   short \u0085"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["filter_reason"], r["bad_word_count"]) for r in
           Q.annotate_quality(df, lexicon=LEX).collect()}
    bad = [(t, got[i], python_verdict(t, LEX)) for i, t in enumerate(texts) if got[i] != python_verdict(t, LEX)]
    assert not bad, bad[:5]
