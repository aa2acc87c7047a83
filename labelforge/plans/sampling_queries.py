"""Corpus assembly, sampling, balancing and splitting queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import corpus as C
from ..operators import sampling as R
from ..operators.common import materialise
from ..sources import fixtures as V
from ..sources.tables import documents
from .registry import register

COMMON = "text, round(language_score, 6) AS language_score, CAST(token_count AS INTEGER) AS token_count, int_score"
QUOTAS = {0: 30, 1: 30, 2: 30, 3: 30, 4: 30}


def _src(spark, sf, name):
    return V.v_corpus(spark, sf).filter(F.col("snapshot") == name)


def _r6(df):
    return df.withColumn("language_score", F.round("language_score", 6))


@register("bounded_ingest", f"""SELECT {COMMON} FROM v_corpus WHERE snapshot = 'src1'
    ORDER BY doc_id LIMIT 20""", ("v_corpus",))
def bounded_ingest(spark, sf):
    return _r6(C.bounded_ingest(_src(spark, sf, "src1"), 20, "doc_id"))


@register("merge_sources", f"""SELECT * FROM (SELECT {COMMON}, 'src0' AS source_name FROM v_corpus
      WHERE snapshot = 'src0' ORDER BY doc_id LIMIT 25)
    UNION ALL SELECT * FROM (SELECT {COMMON}, 'src1' AS source_name FROM v_corpus
      WHERE snapshot = 'src1' ORDER BY doc_id LIMIT 15)
    UNION ALL SELECT {COMMON}, 'src2' AS source_name FROM v_corpus WHERE snapshot = 'src2'""", ("v_corpus",))
def merge_sources(spark, sf):
    srcs = [("src0", _src(spark, sf, "src0"), 25), ("src1", _src(spark, sf, "src1"), 15),
            ("src2", _src(spark, sf, "src2").drop("int_score").withColumnRenamed("raw_score", "score"), -1)]
    return _r6(C.merge_sources(srcs, "doc_id", spark))


@register("merge_training_set", """SELECT * FROM (SELECT doc_id, lang, int_score FROM v_scored WHERE lang = 'en'
      ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40)
    UNION ALL SELECT * FROM (SELECT doc_id, lang, int_score FROM v_scored WHERE lang <> 'en'
      AND int_score BETWEEN 4 AND 5 ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25)""",
          ("v_scored",))
def merge_training_set(spark, sf):
    s = V.v_scored(spark, sf).select("doc_id", "lang", "int_score")
    en = s.filter(F.col("lang") == "en")
    other = s.filter((F.col("lang") != "en") & F.col("int_score").between(4, 5))
    return C.merge_training_set([(en, 40), (other, 25)], "doc_id", 42, spark)


_BAL_SQL = """SELECT doc_id, int_score FROM v_scored WHERE int_score = 5
    UNION ALL SELECT doc_id, int_score FROM (SELECT doc_id, int_score,
      row_number() OVER (PARTITION BY int_score ORDER BY doc_id) AS rn FROM v_scored
      WHERE int_score BETWEEN 0 AND 4) WHERE rn <= 30"""


@register("balance_classes", _BAL_SQL, ("v_scored",))
def balance_classes(spark, sf):
    s = V.v_scored(spark, sf).select("doc_id", "int_score")
    return R.cap_per_class(s, "int_score", QUOTAS, "doc_id")


@register("merge_top_class", f"""SELECT doc_id, CASE WHEN int_score = 5 THEN 4 ELSE int_score END AS int_score
    FROM ({_BAL_SQL})""", ("v_scored",))
def merge_top_class(spark, sf):
    return C.merge_top_class(balance_classes(spark, sf))


@register("score_distribution", """SELECT d.score, coalesce(c.n, 0) AS n FROM range(6) t(score0)
    CROSS JOIN LATERAL (SELECT CAST(score0 AS INTEGER) AS score) d
    LEFT JOIN (SELECT int_score AS score, count(*) AS n FROM v_scored GROUP BY 1) c ON c.score = d.score""",
          ("v_scored",))
def score_distribution(spark, sf):
    return C.score_distribution(spark, V.v_scored(spark, sf))


@register("biased_sample", """WITH base AS (
      SELECT doc_id, regexp_extract_all(educational_value_labels, '''(.*?)''', 1) AS l FROM v_panel_text
      WHERE problematic_content_label_present = FALSE),
    b AS (SELECT doc_id, list_contains(l, 'Excellent') OR (list_contains(l, 'Good')
            AND CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 <= 0.7) AS keep
          FROM base WHERE len(l) > 2),
    chosen AS (SELECT doc_id FROM b WHERE keep),
    topup AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || CAST(doc_id AS VARCHAR)), doc_id) AS r
              FROM b WHERE NOT keep) WHERE r <= 100 - (SELECT count(*) FROM chosen)),
    s AS (SELECT doc_id FROM chosen UNION ALL SELECT doc_id FROM topup)
    SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM s""",
          ("v_panel_text",))
def biased_sample(spark, sf):
    p = V.v_panel_text(spark, sf).select(
        "doc_id", S.parse_list_text("educational_value_labels").alias("labels"),
        "problematic_content_label_present")
    out = R.biased_sample(p, 100, 0.7, "doc_id", "labels", "problematic_content_label_present")
    return out.select("doc_id", "pos")


@register("biased_sample_topup", """WITH base AS (
      SELECT doc_id, regexp_extract_all(educational_value_labels, '''(.*?)''', 1) AS l FROM v_panel_text
      WHERE problematic_content_label_present = FALSE),
    b AS (SELECT doc_id, list_contains(l, 'Excellent') OR (list_contains(l, 'Good')
            AND CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 <= 0.7) AS keep
          FROM base WHERE len(l) > 2),
    chosen AS (SELECT doc_id FROM b WHERE keep),
    topup AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || CAST(doc_id AS VARCHAR)), doc_id) AS r
              FROM b WHERE NOT keep) WHERE r <= (SELECT count(*) * 9 // 10 FROM b) - (SELECT count(*) FROM chosen)),
    s AS (SELECT doc_id FROM chosen UNION ALL SELECT doc_id FROM topup)
    SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM s""",
          ("v_panel_text",))
def biased_sample_topup(spark, sf):
    """The sample's size is nine tenths of the eligible rows, more than are
    kept, so the rest is topped up."""
    p = V.v_panel_text(spark, sf).select(
        "doc_id", S.parse_list_text("educational_value_labels").alias("labels"),
        "problematic_content_label_present")
    out = R.biased_sample(p, lambda _, eligible: F.floor(eligible * 9 / 10), 0.7, "doc_id", "labels",
                          "problematic_content_label_present")
    return out.select("doc_id", "pos")


@register("train_val_split", """SELECT doc_id, CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
          count(*) OVER () AS n FROM v_scored)""", ("v_scored",))
def train_val_split(spark, sf):
    s = V.v_scored(spark, sf).select("doc_id")
    return R.train_val_split(s, 0.2, "doc_id", 42).select("doc_id", "split")


@register("stratified_split", """SELECT doc_id, label, CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split
    FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
          count(*) OVER (PARTITION BY label) AS n
          FROM (SELECT doc_id, CAST(greatest(0, least(4, round_even(raw_score, 0))) AS INTEGER) AS label FROM v_scored))""",
          ("v_scored",))
def stratified_split(spark, sf):
    s = V.v_scored(spark, sf).select("doc_id", S.discretize("raw_score").alias("label"))
    return R.train_val_split(s, 0.2, "doc_id", 42, stratify_col="label").select("doc_id", "label", "split")


@register("next_item", """SELECT doc_id FROM v_scored s WHERE NOT EXISTS
    (SELECT 1 FROM v_annotated a WHERE a.text = s.text) ORDER BY doc_id LIMIT 1""", ("v_scored", "v_annotated"))
def next_item(spark, sf):
    from ..operators.joins import remaining
    rem = remaining(V.v_scored(spark, sf), V.v_annotated(spark, sf), "text")
    return rem.agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())


@register("remaining_items", """SELECT doc_id FROM v_scored s WHERE NOT EXISTS
    (SELECT 1 FROM v_annotated a WHERE a.text = s.text)""", ("v_scored", "v_annotated"))
def remaining_items(spark, sf):
    from ..operators.joins import remaining
    return remaining(V.v_scored(spark, sf), V.v_annotated(spark, sf), "text").select("doc_id")


@register("annotation_progress", """SELECT count(*) AS total,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_annotated a WHERE a.text = s.text)) AS annotated,
    round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_annotated a WHERE a.text = s.text)) / count(*), 6) AS fraction
    FROM v_scored s""", ("v_scored", "v_annotated"))
def annotation_progress(spark, sf):
    from ..operators.joins import progress
    return progress(V.v_scored(spark, sf), V.v_annotated(spark, sf), "text")


@register("subset_load", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def subset_load(spark, sf):
    return documents(spark, sf).filter(F.col("lang") == "fr").select("doc_id", "lang", "source")


@register("limit_then_filter", """SELECT doc_id, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000)
    WHERE contains(text, 'license')""")
def limit_then_filter(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return R.first_n(d, 1000, "doc_id").filter(F.col("text").contains("license"))


@register("training_corpus_distribution", f"""WITH m AS (
      SELECT * FROM (SELECT doc_id, int_score FROM v_corpus WHERE snapshot = 'src0' ORDER BY doc_id LIMIT 25)
      UNION ALL SELECT * FROM (SELECT doc_id, int_score FROM v_corpus WHERE snapshot = 'src1' ORDER BY doc_id LIMIT 15)
      UNION ALL SELECT doc_id, int_score FROM v_corpus WHERE snapshot = 'src2'),
    capped AS (SELECT doc_id, int_score FROM m WHERE int_score = 5
      UNION ALL SELECT doc_id, int_score FROM (SELECT doc_id, int_score,
        row_number() OVER (PARTITION BY int_score ORDER BY doc_id) AS rn FROM m WHERE int_score BETWEEN 0 AND 4)
      WHERE rn <= 10)
    SELECT CAST(d.v AS INTEGER) AS score, coalesce(c.n, 0) AS n FROM range(6) d(v)
    LEFT JOIN (SELECT int_score AS score, count(*) AS n FROM capped GROUP BY 1) c ON c.score = d.v""", ("v_corpus",))
def training_corpus_distribution(spark, sf):
    """Bounded ingest of three sources into the common schema, merged,
    capped per class (first rows by key; class 5 unlimited), then the score
    distribution over 0..5 with zeros."""
    parts = []
    for name, n in (("src0", 25), ("src1", 15), ("src2", -1)):
        src = _src(spark, sf, name).select("doc_id", "int_score")
        parts.append(src if n < 0 else R.first_n(src, n, "doc_id"))
    merged = materialise(C.union_all(parts, spark))  # keys and scores, read again by each histogram
    capped = R.cap_per_class(merged, "int_score", {k: 10 for k in range(5)}, "doc_id")
    return C.score_distribution(spark, capped)


@register("selections_of_repeated_ids", """WITH t AS (
      SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id // 10 END AS id FROM documents),
    g AS (SELECT id, md5('42:' || CAST(id AS VARCHAR)) AS h, count(*) AS c FROM t GROUP BY id),
    o AS (SELECT id, c, sum(c) OVER (ORDER BY id IS NULL, h, id) - c AS by_hash,
            sum(c) OVER (ORDER BY id IS NULL, id) - c AS by_id, sum(c) OVER () AS total FROM g),
    s AS (SELECT 'sample' AS selection, id, least(c, greatest(0, 333 - by_hash)) AS n FROM o
      UNION ALL SELECT 'first', id, least(c, greatest(0, 333 - by_id)) FROM o WHERE id IS NOT NULL
      UNION ALL SELECT 'train', id, least(c, greatest(0, floor(0.8 * total) - by_hash)) FROM o)
    SELECT selection, id, CAST(n AS BIGINT) AS n FROM s WHERE n > 0""")
def selections_of_repeated_ids(spark, sf):
    """Rows per id in three selections over ids that repeat and are null."""
    t = documents(spark, sf).select(
        F.when(F.col("doc_id") % 50 != 0, F.floor(F.col("doc_id") / 10)).alias("id"), "doc_id")
    train = R.train_val_split(t, 0.2, "id", 42).where("split = 'train'")
    parts = {"sample": R.sample_n(t, 333, "id", 42), "first": R.first_n(t, 333, "id"), "train": train}
    rows = [df.select(F.lit(name).alias("selection"), "id") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("selection", "id").agg(F.count("*").alias("n"))


@register("stratified_split_exact", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN (doc_id * doc_id) % 11 END AS label FROM documents),
    c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS every FROM d GROUP BY label),
    t AS (SELECT *, CAST(floor(0.8 * every) AS BIGINT) AS total FROM c),
    q AS (SELECT label, total, total * n // every AS seats, row_number() OVER (ORDER BY total * n % every DESC, label NULLS LAST) AS place,
            total - sum(total * n // every) OVER () AS extra FROM t),
    r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM d)
    SELECT doc_id, r.label, CASE WHEN r <= seats + CASE WHEN place <= extra THEN 1 ELSE 0 END THEN 'train' ELSE 'validation' END AS split
    FROM r JOIN q ON r.label IS NOT DISTINCT FROM q.label""")
def stratified_split_exact(spark, sf):
    """A split with exactly floor(0.8 n) train rows over classes of awkward
    sizes, null among them."""
    label = F.when(F.col("doc_id") % 97 != 0, F.col("doc_id") * F.col("doc_id") % 11)
    d = documents(spark, sf).select("doc_id", label.alias("label"))
    return R.stratified_split(d, 0.2, "doc_id", "label", 42).select("doc_id", "label", "split")
