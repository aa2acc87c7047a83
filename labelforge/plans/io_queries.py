"""File round trips and batch scoring queries. Files go to a fresh
sub-folder of the shared checkpoint folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import decode_code, discretize
from ..operators import corpus as C
from ..operators import metrics as MT
from ..operators import ml as ML
from ..operators.reshape import wide_to_long
from ..operators.sampling import first_n
from ..session import scratch_path
from ..sources import fixtures as V
from ..sources import io as IO
from ..sources.tables import documents
from .model_queries import TOKEN_SCORES_SQL, fitted_quality, labelled_quality, token_head
from .registry import register

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@register("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    IO.write_csv(documents(spark, sf), path)
    return IO.read_csv(spark, path, DOC_SCHEMA)


_BAD_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                            T.StructField("source", T.StringType())])


@register("csv_bad_lines", """SELECT doc_id, lang,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0""")
def csv_bad_lines(spark, sf):
    """Lines with an extra field, filled or empty (doc_id % 7 = 0), are
    skipped, lines missing the last field (doc_id % 11 = 0) are padded with
    null."""
    d = documents(spark, sf)
    extra = F.when(d.doc_id % 2 == 0, F.lit("extra")).otherwise(F.lit(""))
    line = (F.when(d.doc_id % 7 == 0, F.concat_ws(",", d.doc_id.cast("string"), "lang", "source", extra))
            .when(d.doc_id % 11 == 0, F.concat_ws(",", d.doc_id.cast("string"), "lang"))
            .otherwise(F.concat_ws(",", d.doc_id.cast("string"), "lang", "source")))
    path = scratch_path(spark, "badcsv")
    d.select(line.alias("value")).write.mode("overwrite").text(path)  # header-less line files
    return IO.read_csv_skip_long_rows(spark, path, _BAD_SCHEMA, header=False)


@register("json_roundtrip", "SELECT doc_id, raw_score, int_score, lang FROM v_scored", ("v_scored",))
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "jsonl")
    IO.write_json_lines(V.v_scored(spark, sf).select("doc_id", "raw_score", "int_score", "lang"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("raw_score", T.DoubleType()),
                           T.StructField("int_score", T.IntegerType()), T.StructField("lang", T.StringType())])
    return IO.read_json_lines(spark, path, schema)


@register("jsonl_to_csv", "SELECT text, gemini_prediction AS int_score FROM v_llm", ("v_llm",))
def jsonl_to_csv(spark, sf):
    src, dst = scratch_path(spark, "llm-jsonl"), scratch_path(spark, "llm-csv")
    IO.write_json_lines(V.v_llm(spark, sf).select("text", "gemini_prediction"), src)
    IO.jsonl_to_csv(spark, src, dst)
    return IO.read_csv(spark, dst, T.StructType([T.StructField("text", T.StringType()),
                                                 T.StructField("int_score", T.IntegerType())]))


@register("json_array", "SELECT doc_id, lang, source FROM documents")
def json_array(spark, sf):
    """JSON array files, one of at most 500 consecutive ids each."""
    path = scratch_path(spark, "json-array")
    record = F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"})
    rows = documents(spark, sf).groupBy(F.floor(F.col("doc_id") / 500).alias("chunk")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("chunk").text(path)
    return IO.read_json_array(spark, path, _BAD_SCHEMA).select("doc_id", "lang", "source")


@register("csv_by_ranges", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_by_ranges(spark, sf):
    """CSV files with line ends in quoted texts, read by byte ranges."""
    path = scratch_path(spark, "csv-ranges")
    IO.write_csv(documents(spark, sf), path)
    return IO.read_csv(spark, path, DOC_SCHEMA, by_ranges=True)


@register("json_array_by_ranges", "SELECT doc_id, text, lang FROM documents")
def json_array_by_ranges(spark, sf):
    """JSON array files of texts, one of at most 500 consecutive ids each, read
    by byte ranges."""
    path = scratch_path(spark, "json-ranges")
    record = F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})
    rows = documents(spark, sf).groupBy(F.floor(F.col("doc_id") / 500).alias("chunk")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ", "), F.lit("]")).alias("value"))
    rows.write.partitionBy("chunk").text(path)
    schema = T.StructType([DOC_SCHEMA["doc_id"], DOC_SCHEMA["text"], DOC_SCHEMA["lang"]])
    return IO.read_json_array(spark, path, schema, by_ranges=True)


@register("limit_filter_jsonl", """SELECT doc_id, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000)
    WHERE contains(text, 'license')""")
def limit_filter_jsonl(spark, sf):
    """Reader, limit, filter and JSON-lines writer as one job."""
    path = scratch_path(spark, "limited-jsonl")
    d = first_n(documents(spark, sf).select("doc_id", "text"), 1000, "doc_id")
    IO.write_json_lines(d.filter(F.col("text").contains("license")), path)
    return IO.read_json_lines(spark, path, T.StructType([T.StructField("doc_id", T.LongType()),
                                                         T.StructField("text", T.StringType())]))


@register("annotation_append", f"""SELECT our_label, count(*) AS n FROM (SELECT DISTINCT doc_id,
    coalesce({V.LABELS_SQL}[int_score + 1], CAST(int_score AS VARCHAR)) AS our_label
    FROM v_annotated) GROUP BY our_label""", ("v_annotated",))
def annotation_append(spark, sf):
    """All annotations appended to a JSON dataset in one write, whatever their
    language, then the label distribution of distinct annotated items."""
    path = scratch_path(spark, "annotations")
    a = V.v_annotated(spark, sf).select("doc_id", decode_code("int_score").alias("our_label"))
    IO.append_records(a, path)
    back = IO.read_or_empty(spark, path, T.StructType([T.StructField("doc_id", T.LongType()),
                                                       T.StructField("our_label", T.StringType())]), "json")
    return back.dropDuplicates(["doc_id"]).groupBy("our_label").agg(F.count(F.lit(1)).alias("n"))


@register("classify_batch", TOKEN_SCORES_SQL)
def classify_batch(spark, sf):
    """Every non-empty document scored, on its first 512 tokens, by a head
    fitted on the labelled ones."""
    scored = ML.score_tokens(token_head(spark, sf), documents(spark, sf).select("doc_id", "text"))
    return scored.select("doc_id", (F.round("score", 6) + 0.0).alias("score"), "int_score")


@register("clean_translated", "SELECT text, int_score FROM v_scored", ("v_scored",))
def clean_translated(spark, sf):
    """A corpus with a translation column -> validate columns -> keep the
    translation as text. (No translator ships with this library: the column
    holds the text itself.)"""
    t = V.v_scored(spark, sf).select("text", F.col("text").alias("Translated_text"), "int_score")
    C.require_columns(t, ["Translated_text", "int_score"])
    out = t.select(F.col("Translated_text"), "int_score").withColumnRenamed("Translated_text", "text")
    path = scratch_path(spark, "translated")
    IO.write_csv(out, path)
    return IO.read_csv(spark, path, T.StructType([T.StructField("text", T.StringType()),
                                                  T.StructField("int_score", T.IntegerType())]))


@register("evaluate_models", """SELECT m AS model_name, count(*) AS n, TRUE AS in_range
    FROM documents JOIN labels USING (doc_id), (SELECT unnest(['mean', 'text_small', 'text_wide']) AS m)
    WHERE length(text) > 0 AND quality IS NOT NULL GROUP BY m""")
def evaluate_models(spark, sf):
    """Several fitted models over one scan: one prediction column per model,
    stacked long, then one contingency aggregate. The oracle checks the counts
    and that every figure lies in its range."""
    models = {"text_small": fitted_quality(spark, sf, 1 << 8), "text_wide": fitted_quality(spark, sf)}
    base = labelled_quality(spark, sf).where(F.length("text") > 0)
    rows = base.select("text", F.col("quality").alias("true_label"), F.lit(0.5).alias("raw_prediction_mean"))
    for name, model in models.items():
        rows = ML.score_text(model, rows).withColumnRenamed("score", f"raw_prediction_{name}").drop("int_score")
    for name in ("mean", *models):
        rows = rows.withColumn(f"predicted_label_{name}", discretize(f"raw_prediction_{name}"))
    s = MT.summary(wide_to_long(rows.drop("text"), ["true_label"]))
    return s.select("model_name", F.col("n").cast("long").alias("n"),
                    (F.col("accuracy").between(0, 1) & (F.col("mse") >= 0)).alias("in_range"))
