import random

import pytest

from labelforge.llm import langid

PAGE = "page_id long, url string, html string, host string, lang string"
WORDS = {"en": ["the", "and", "with", "thing", "where"], "de": ["der", "und", "nicht", "schon", "über"],
         "fr": ["les", "dans", "où", "être", "avec"]}


def say(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture
def learnt(docs):
    r = random.Random(1)
    rows = [(i, say(l, 40, r), l, "s", 1) for i, l in enumerate(list(WORDS) * 20)]
    return docs(rows + [(900, None, "en", "s", 1), (901, "the", None, "s", 1)])


def run(spark, learnt, rows):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], PAGE).repartition(3)
    return sorted(langid.identify(df, learnt).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))


def page(text, lang=None):
    mark = f' lang="{lang}"' if lang else ""
    return f"<!DOCTYPE html><html{mark}><head><style>the and</style></head><body><p>{text}</p><!-- the --></body></html>"


def test_text_decides_and_markup_breaks_ties(spark, learnt):
    r = random.Random(2)
    rows = [(i, f"http://h{i % 5}.example.org/{i}", page(say(l, 60, r), l)) for i, l in enumerate(list(WORDS) * 30)]
    rows += [(500, "http://x.example.org/", page("", "de")),  # no text: the declared language
             (501, "http://y.example.org/", page(say("fr", 80, r), "en"))]  # wrong markup: the text
    got = {x["page_id"]: x for x in run(spark, learnt, rows)}
    assert all(got[i]["lang"] == l for i, l in enumerate(list(WORDS) * 30))
    assert got[500]["lang"] == "de" and got[500]["text_lang"] is None
    assert got[501]["lang"] == "fr" and got[501]["declared_lang"] == "en"
    assert all(0 < x["probability"] <= 1 + 1e-9 for x in got.values())


def test_host_prior_decides_for_empty_pages(spark, learnt):
    r = random.Random(3)
    rows = [(i, f"https://hot.example.com/{i}", page(say("de", 50, r))) for i in range(200)]
    rows += [(i, f"https://fr{i}.example.net/", page(say("fr", 50, r))) for i in range(300, 340)]
    rows += [(i, f"https://en{i}.other.net/", page(say("en", 50, r))) for i in range(400, 440)]
    rows += [(900, "https://hot.example.com/empty", page("")), (901, "https://new.example.net/", page(""))]
    got = {x["page_id"]: x["lang"] for x in run(spark, learnt, rows)}
    assert got[900] == "de" and got[901] == "fr"  # host; then the domain


def test_odd_pages(spark, learnt):
    rows = [(1, None, None), (2, "not an address", page("der und nicht schon über der und")), (None, "http://a.de/", ""),
            (3, "HTTP://User@HOST.example.DE:80/x", page("les dans où être avec les dans", "FR-ca")),
            (3, "HTTP://User@HOST.example.DE:80/x", page("les dans où être avec les dans", "FR-ca"))]
    got = run(spark, learnt, rows)
    assert [x["page_id"] for x in got] == [1, 2, 3, 3, None]
    assert got[0]["lang"] in WORDS and got[0]["text_lang"] is None and got[0]["host"] == ""
    assert got[1]["lang"] == "de" and got[2]["lang"] == "fr"
    assert got[2]["host"] == "host.example.de" and got[2]["declared_lang"] == "fr"


def test_empty_tables(spark, docs, learnt):
    assert run(spark, learnt, []) == []
    none = run(spark, docs([]), [(1, "http://a.b/", page("the", "en"))])
    assert none[0]["lang"] is None and none[0]["declared_lang"] == "en"


def test_long_page(spark, learnt):
    r = random.Random(5)
    assert run(spark, learnt, [(1, "http://a.b/", page(say("fr", 100000, r)))])[0]["lang"] == "fr"


def test_letters_written_as_references(spark, learnt):
    r = random.Random(4)
    texts = [(l, say(l, 30, r)) for l in list(WORDS) * 4]
    ways = [lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):X};", lambda c: {"ü": "&uuml;", "ù": "&ugrave;", "ê": "&ecirc;"}.get(c, c)]
    rows = []
    for i, (_, t) in enumerate(texts):
        rows.append((10 * i, None, page(t)))
        rows += [(10 * i + k, None, page("".join(map(w, t)))) for k, w in enumerate(ways, 1)]
    rows += [(900, None, page("&nbsp;&#160; &#32;")), (901, None, page("&lt;p&gt; &amp;uuml;"))]
    got = {x["page_id"]: x for x in run(spark, learnt, rows)}
    for i, (l, _) in enumerate(texts):
        assert [got[10 * i + k]["text_lang"] for k in range(4)] == [l] * 4
        assert len({round(got[10 * i + k]["probability"], 9) for k in range(4)}) == 1
    assert got[900]["text_lang"] is None


def test_decoded_texts():
    import pyarrow as pa
    texts = [None, "", "plain", "a &lt;b&gt; &amp;uuml; c&#1055;", " &nbsp;&#32;", "&#xD800;"]
    assert langid.decoded(pa.array(texts)).to_pylist() == [None, "", "plain", "a <b> &uuml; cП", "", "�"]
    assert langid.decoded(pa.array([None], pa.string())).to_pylist() == [None]
