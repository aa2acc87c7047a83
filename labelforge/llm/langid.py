"""Language of web pages by Bayesian evidence fusion.

    log P(l | page) = tempered text likelihood P(grams | l)
                    + log P(declared markup language | l)
                    + log P(address suffix | l)
                    + log P(l | host), smoothed towards the domain, and that
                      towards all pages

The text model is a byte-trigram naive Bayes over all labelled documents. The
other three terms are grouped counts over all pages, by the language that the
text alone suggests; a page's own count is left out of its host and domain, so
no page votes for itself. Trigrams of one text are not independent, hence the
tempering: the likelihood of n trigrams weighs n / (1 + n / TEMPER).

Defined results: a null page or one without text has no text evidence (and
does not vote); a null or malformed address has the empty host and suffix;
pages without any lang attribute declare ''; repeated rows are pages of their
own; documents without lang or text teach nothing; without any labelled
document every language is null; empty pages give no rows; other columns are
ignored. The set of language codes is taken to be small.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import small_batches, stage
from .textbytes import LOWER, flat, slices

BUCKETS, TEMPER, STRENGTH = 1 << 16, 100.0, 4.0


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram, and the first trigram of each row."""
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435769)) >> np.uint32(16)
    inside = np.ones(len(h), bool)
    for back in (1, 2):
        cut = offsets[1:] - back
        inside[cut[(cut >= 0) & (cut < len(h))]] = False
    start = np.concatenate(([0], np.cumsum(inside)))
    return h[inside].astype(np.int64), start[np.minimum(offsets, len(h))]


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language codes and log P(bucket | language), buckets x languages."""
    known = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    number = {l: i for i, l in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            which = np.array([number[l] for l in batch.column(0).to_pylist()], np.int64)
            data, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                own = offsets[a:b + 1] - offsets[a]
                h, start = grams(data[offsets[a]:offsets[b]], own)
                rows = np.repeat(which[a:b], np.diff(start))
                total += np.bincount(rows * BUCKETS + h, minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([t.tobytes() for t in total], pa.binary())],
                                         names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column(1))
        return pa.table({"lang": table.column(0)[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in known.mapInArrow(
        count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()}
    table = np.array([got[l] for l in langs], np.float64).reshape(len(langs), BUCKETS) + 0.5
    return langs, np.log(table / table.sum(1, keepdims=True)).T


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, navigation, comments and tags; its
    character references are still in it (see decoded)."""
    for pattern in (r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def decoded(column: pa.Array) -> pa.Array:
    """The texts with their character references as the characters they name."""
    if not pc.any(pc.match_substring(column, "&")).as_py():
        return column
    return pa.array([" ".join(unescape(t).split()) if t and "&" in t else t for t in column.to_pylist()], pa.string())


def address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
            "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1)}


def declared(html: Column) -> Column:
    """First two or three letters of the html element's lang attribute."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")),
                                    r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))


def _evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """pages with evidence: the tempered log likelihood per language, or null."""
    block = pages.sparkSession.sparkContext.broadcast(model)
    k = model.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = block.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = flat(decoded(batch.column(at)))
            out: list = []
            for a, b in slices(offsets):
                h, start = grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                n = np.diff(start)
                rows = np.repeat(np.arange(b - a), n)
                ll = np.stack([np.bincount(rows, m[h, i], b - a) for i in range(k)], 1).astype(float)
                ll /= (1 + n / TEMPER)[:, None]
                out += [x if size else None for x, size in zip(ll.tolist(), n)]
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.float64()))], names=[*names, "evidence"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "text")
    return pages.mapInArrow(run, schema + ", evidence array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared_lang, host per page."""
    langs, model = text_model(docs)
    cols = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"),
                        *[c.alias(n) for n, c in address(F.col("url")).items()],
                        declared(F.col("html")).alias("declared_lang"), visible_text(F.col("html")).alias("text"))
    if not langs:
        return cols.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias(
            "probability"), F.lit(None).cast("string").alias("text_lang"), "declared_lang", "host")
    k = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    seen = stage(_evidence(cols, model), "page-evidence")
    best = F.array_position("evidence", F.array_max("evidence")).cast("int")  # 1 up; null without text
    seen = seen.withColumn("vote", best)

    def tally(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(F.array(*[
            F.sum((F.coalesce(F.col("vote"), F.lit(0)) == i + 1).cast("double")) for i in range(k)]).alias("n"))

    def pull(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(tally(key).withColumnRenamed("n", name), key, "left")

    def each(f) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), f)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    whole = tally().withColumnRenamed("n", "n_all")
    marked = pull(pull(pull(pull(seen, "host", "n_host"), "domain", "n_domain"), "declared_lang", "n_declared"),
                  "suffix", "n_suffix").crossJoin(F.broadcast(whole))  # one row
    own = each(lambda i: (F.coalesce(F.col("vote"), F.lit(0)) == i + 1).cast("double"))

    def smooth(n: str, base: str) -> Column:
        left = total(F.col(n)) - total(F.col("own"))
        return each(lambda i: (F.get(n, i) - F.get("own", i) + STRENGTH * F.get(base, i)) / (left + STRENGTH))

    def likelihood(n: str) -> Column:  # P(value | language), the page's own vote left out
        return each(lambda i: F.log((F.get(n, i) - F.get("own", i) + 0.5)
                                    / (F.get("n_all", i) - F.get("own", i) + 1.0)))

    out = (marked.withColumn("own", own)
           .withColumn("p_all", each(lambda i: (F.get("n_all", i) + 1.0) / (total(F.col("n_all")) + float(k))))
           .withColumn("p_domain", smooth("n_domain", "p_all")).withColumn("p_host", smooth("n_host", "p_domain"))
           .withColumn("l_declared", likelihood("n_declared")).withColumn("l_suffix", likelihood("n_suffix"))
           .withColumn("log_p", each(lambda i: F.coalesce(F.get("evidence", i), F.lit(0.0)) + F.log(F.get("p_host", i))
                                     + F.get("l_declared", i) + F.get("l_suffix", i)))
           .withColumn("top", F.array_max("log_p")))
    return out.select(
        "page_id", F.element_at(names, F.array_position("log_p", F.col("top")).cast("int")).alias("lang"),
        (1.0 / total(F.transform("log_p", lambda x: F.exp(x - F.col("top"))))).alias("probability"),
        F.when(F.col("evidence").isNotNull(), F.element_at(names, F.col("vote"))).alias("text_lang"),
        "declared_lang", "host")
