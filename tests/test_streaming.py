"""Streaming jobs resume from their checkpoint: a rerun after new files
arrive processes only the new files, and every record lands exactly once."""

from pyspark.sql import functions as F

from labelforge.plans.io_queries import DOC_SCHEMA
from labelforge.session import scratch_path
from labelforge.sources.tables import documents
from labelforge.streaming import jobs as ST
from tests.conftest import SMALL


def test_score_stream_resumes_from_checkpoint(spark):
    from labelforge.plans.model_queries import fitted_quality
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    model = fitted_quality(spark, SMALL, 1 << 8)
    d = documents(spark, SMALL)
    d.filter(F.col("lang").isin("en", "fr")).write.parquet(src + "/batch1")
    stream = ST.read_stream(spark, src + "/*", DOC_SCHEMA)
    ST.run_to_files(ST.score(stream.select("doc_id", "text"), model), out, ckpt)
    first = spark.read.parquet(out).count()
    d.filter(~F.col("lang").isin("en", "fr")).write.parquet(src + "/batch2")
    stream = ST.read_stream(spark, src + "/*", DOC_SCHEMA)
    ST.run_to_files(ST.score(stream.select("doc_id", "text"), model), out, ckpt)
    back = spark.read.parquet(out)
    n_text = d.filter(F.length("text") > 0).count()
    assert 0 < first < n_text
    assert back.count() == n_text and back.select("doc_id").distinct().count() == n_text


def test_progress_stream_counts_each_item_once(spark):
    out, ckpt = scratch_path(spark, "pout"), scratch_path(spark, "pckpt")
    src = scratch_path(spark, "psrc")
    d = documents(spark, SMALL).select("doc_id", F.lit(3).alias("int_score"))
    d.write.parquet(src + "/a")
    d.write.parquet(src + "/b")  # the same annotations arrive twice
    stream = spark.readStream.schema("doc_id long, int_score int").parquet(src + "/*")
    ST.run_complete_to_table(ST.progress(ST.annotations_from_scores(stream), "doc_id", "our_label"), out, ckpt)
    rows = ST.read_last_batch(spark, out, "our_label string, n long").collect()
    assert [(r["our_label"], r["n"]) for r in rows] == [("Good", d.count())]


def test_progress_with_watermark_dedups_repeats(spark):
    out, ckpt, src = (scratch_path(spark, n) for n in ("wout", "wckpt", "wsrc"))
    d = (documents(spark, SMALL).select("doc_id", F.lit(4).alias("int_score"))
         .withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    d.write.parquet(src + "/a")
    d.write.parquet(src + "/b")
    stream = spark.readStream.schema("doc_id long, int_score int, ts timestamp").parquet(src + "/*")
    ann = stream.select("doc_id", "ts", F.lit("Excellent").alias("our_label"))
    ST.run_complete_to_table(ST.progress(ann, "doc_id", "our_label", "ts", "1 hour"), out, ckpt)
    rows = ST.read_last_batch(spark, out, "our_label string, n long").collect()
    assert [(r["our_label"], r["n"]) for r in rows] == [("Excellent", d.count())]


def test_streaming_quality_split_equals_batch(spark):
    from labelforge.operators import quality as Q
    lex = ["worthless", "idiot", "license", "licensed"]
    stream = ST.read_stream(spark, f"{SMALL}/documents.parque[t]", DOC_SCHEMA)
    clean_s, prob_s = ST.quality_split(spark, stream, "qs-test", lexicon=lex)
    clean_b, prob_b = Q.filter_dataset(documents(spark, SMALL), lexicon=lex)
    assert sorted(r["doc_id"] for r in clean_s.collect()) == sorted(r["doc_id"] for r in clean_b.collect())
    assert sorted((r["doc_id"], r["filter_reason"]) for r in prob_s.collect()) == \
        sorted((r["doc_id"], r["filter_reason"]) for r in prob_b.collect())


def test_bounded_ingest_takes_the_first_of_each_source(spark):
    """Several sources in several batches, null keys and sources, repeated keys,
    a batch that is run again after a crash, and a restart of the job."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("isrc", "iout", "ickpt"))
    schema = "id long, source string, text string"
    batches = [
        [(9, "a", "1"), (3, "a", "2"), (None, "a", "3"), (5, "b", "4"), (5, "b", "5"), (1, None, "6")],
        [(1, "a", "7"), (2, "a", "8"), (0, "b", "9"), (7, "b", "10"), (6, "b", "11"), (8, "c", "12")],
        [],
        [(i, s, f"last {i}") for i in range(6) for s in ("a", "b", "c", None)]]
    n, taken, want = 5, {}, []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{number}")
        job = ST.BoundedIngest(spark, out, n, "source", "id")  # a new driver each time
        if number == 1:  # the batch runs to its end, then the commit of its offsets is lost
            job.write(spark.createDataFrame(rows[:2], schema), number)
        got = job.run(spark.readStream.schema(schema).parquet(f"{src}/*"), ckpt)
        for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            if taken.get(r[1], 0) < n:
                taken[r[1]] = taken.get(r[1], 0) + 1
                want.append(r)
        assert sorted(tuple(r)[:3] for r in got.where("text not like 'last%'").collect() if r["source"] and r["id"] is not None) \
            == sorted(w for w in want if w[1] and w[0] is not None and not w[2].startswith("last"))
        assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == taken
    assert taken == {"a": 5, "b": 5, "c": 5, None: 5}
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got.collect())
