"""The registered queries against their oracles or plain recomputations, and
the pipeline against its stages, on the small tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F

from labelforge.llm import decontaminate, filters, neardup, toxicity
from labelforge.llm.queries import LLM_ORACLE, LLM_QUERIES, vocabulary
from labelforge.sources.tables import TABLES, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_docs(spark):
    return [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SMALL)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(cur.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(LLM_QUERIES) <= set(E.queries())


def test_near_duplicates(spark, small_docs):
    from .test_neardup import brute
    got = E.queries()["op2_near_duplicates"](spark, SMALL).collect()
    want = {r[0]: (r[2], r[3]) for r in brute(small_docs)}
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == want


def test_suffix_repeats(spark, small_docs):
    from .test_suffixes import brute
    got = E.queries()["op10_suffix_repeats"](spark, SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(small_docs)


def test_token_counts(spark, small_docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {}
    for i, t in small_docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i] = (i, len((t or "").encode()), n, n > 2048)
    assert {r[0]: tuple(r) for r in E.queries()["op4_token_counts"](spark, SMALL).collect()} == want


def test_toxicity_and_language_model_columns(spark, small_docs):
    for name, part, parts in (("op1_toxicity", "predicted", 4), ("op6_class_lm", "score", 7)):
        rows = E.queries()[name](spark, SMALL).collect()
        assert {r["doc_id"]: r["held_out"] for r in rows} == {
            i: zlib.crc32(str(i).encode()) % parts == 2 for i, _ in small_docs}
        assert all(r[part] is not None for r in rows)


def test_language_id_of_the_pages(spark):
    got = E.queries()["op3_language_id"](spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "pages").count()
    assert sum(r["lang"] == r["declared_lang"] for r in got) >= 0.95 * len(got)


def test_pipeline_equals_its_stages_recomputed(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.train(docs, table(spark, SMALL, "labels"), ~toxicity.held_out())
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if score[r["doc_id"]] < filters.TOXIC_FROM}
    from .test_decontaminate import brute as overlaps
    from .test_neardup import brute as copies
    rows = {i: rows[i] for i, _, _, kept in copies(list(rows.items()), filters.NEAR_COPY_PERCENT) if kept}
    seen, cut = set(), {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\x01" * 100
            seen.add(b[p:p + 100])
        cut[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    clean = {i for i, _, hit, _ in overlaps(list(cut.items()), items) if not hit}
    out = E.queries()["pipeline"](spark, SMALL).collect()
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: len(lib.encode(cut[i], add_special_tokens=False).ids) + 1 for i in clean}
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages_keep_the_columns(spark, docs):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p, "en", "a", 5), (2, p, "en", "b", 5), (2, p, "en", "b", 5), (3, None, None, None, None),
            (None, "no id", "en", "c", 5), (4, "", "en", "c", 0), (5, p + " and some more words of its own " * 9, "en", "d", 1)]
    df = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SMALL).columns == df.columns, name
        assert stage(spark, docs([]), SMALL).count() == 0, name
    kept = filters.drop_near_copies(spark, df, SMALL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]  # 5 is a near copy of 1 (0.82)
    cut = {r["doc_id"]: r for r in filters.cut_repeats(spark, df, SMALL).collect()}
    assert cut[1]["text"] == p and cut[2]["text"] == "" and cut[2]["n_chars"] == 0 and cut[3]["text"] is None
    assert cut[5]["text"].startswith(" and some")


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and decontaminate.merge([]) == []
    assert neardup.RADIUS // neardup.CHUNKS == 1


def test_stages_pass_clashing_columns_on(spark, docs):
    """Columns of the input that are named like columns of the operators."""
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p, "en", "a", 5), (2, p, "en", "b", 5), (3, None, None, None, None), (4, "some other text", "en", "c", 15)]
    names = ["_first", "toxicity", "spans", "kept", "n_words", "n_kept", "component_id", "item_ids", "node", "family", "id",
             "tie", "doc", "copy kept", "sequence_id", "piece", "length"]
    df = docs(rows)
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and all(r[n] == "mine" for r in got for n in names), name
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SMALL)
    assert {r["piece"] for r in packed.collect()} == {0} and packed.count() == 4
