"""Streaming jobs run with ``availableNow`` over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import digest
from ..session import scratch_path
from ..sources import fixtures as V
from ..sources.tables import documents
from ..streaming import jobs as ST
from ..operators import ml as ML
from .io_queries import DOC_SCHEMA
from .model_queries import TOKEN_SCORES_SQL, token_head
from .quality_queries import _SIG, DOC_COLS
from .registry import register
from ..sources.fixtures import TEST_LEXICON


def _docs_stream(spark, sf):
    # A one-file glob: the file source watches a directory / pattern.
    return ST.read_stream(spark, f"{sf.rstrip('/')}/documents.parque[t]", DOC_SCHEMA)


@register("stream_ingest", "SELECT least(count(*), 100) AS n, least(count(*), 100) AS n_known FROM documents")
def stream_ingest(spark, sf):
    """Bounded ingest into the common schema. Which rows pass the bound
    depends on their arrival; checked are their number and that each one is a
    row of the table."""
    d = V.with_scores(_docs_stream(spark, sf)).drop("int_score").withColumnRenamed("raw_score", "score")
    got = ST.materialise(spark, ST.ingest(d, 100), "stream-ingest")
    known = documents(spark, sf).select(digest("text").alias("_d")).distinct().withColumn("_known", F.lit(1))
    return got.withColumn("_d", digest("text")).join(known, "_d", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_known").alias("n_known"))


@register("stream_ingest_first", """WITH f AS (SELECT doc_id, source, doc_id % 4 AS part FROM documents),
    p AS (SELECT DISTINCT part FROM f)
    SELECT source, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY part, doc_id) <= 20""")
def stream_ingest_first(spark, sf):
    """The first 20 records of every source by arrival and id: the table
    arrives in four files, one a micro-batch, each run from the checkpoint."""
    src, out, ckpt = (scratch_path(spark, f"ingest-{n}") for n in ("src", "out", "ckpt"))
    d = documents(spark, sf).select("doc_id", "source")
    job = ST.BoundedIngest(spark, out, 20, "source", "doc_id")
    for part in range(4):
        d.where(F.col("doc_id") % 4 == part).write.parquet(f"{src}/part={part}")
        stream = ST.read_stream(spark, f"{src}/*", d.schema, max_files_per_trigger=1000)
        got = job.run(stream, ckpt)
    return got.select("source", "doc_id")


@register("stream_score", TOKEN_SCORES_SQL)
def stream_score(spark, sf):
    """The scores of ``classify_batch`` on arriving documents."""
    plan = ML.score_tokens(token_head(spark, sf), _docs_stream(spark, sf).select("doc_id", "text"))
    rounded = (F.round("score", 6) + 0.0).alias("score")
    return ST.materialise(spark, plan.select("doc_id", rounded, "int_score"), "stream-score")


@register("stream_quality", f"WITH {_SIG} SELECT {DOC_COLS} FROM ann WHERE filter_reason = 'Clean content'")
def stream_quality(spark, sf):
    clean, _ = ST.quality_split(spark, _docs_stream(spark, sf), "stream-quality", lexicon=TEST_LEXICON)
    return clean


@register("stream_progress", f"""SELECT our_label, count(*) AS n FROM (SELECT DISTINCT doc_id,
    coalesce({V.LABELS_SQL}[int_score + 1], CAST(int_score AS VARCHAR)) AS our_label
    FROM v_annotated) GROUP BY our_label""", ("v_annotated",))
def stream_progress(spark, sf):
    ann = V.with_scores(_docs_stream(spark, sf)).filter(F.col("doc_id") % 3 == 0)
    plan = ST.progress(ST.annotations_from_scores(ann), "doc_id", "our_label")
    return ST.materialise(spark, plan, "stream-progress", complete=True)
