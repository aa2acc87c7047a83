"""Structured Streaming jobs over arriving text.

Each job is a plain streaming DataFrame plan with a file sink and a
checkpoint, so it is restartable: a re-run resumes from the checkpoint
instead of starting over. ``availableNow`` processes what has arrived and
stops (incremental batch); a continuous trigger works the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import decode_code
from ..operators import corpus as C
from ..operators import ml as ML
from ..operators import quality as Q
from ..operators.sampling import mark_first
from ..session import scratch_path
from ..sources.io import read_or_empty


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_to_files(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                 fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Run the streaming plan over all available input into ``out_path``."""
    w = df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete_to_table(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Complete-mode aggregate: each micro-batch writes the full (small)
    result to a folder of its own, ``out_path/batch=<id>``; the last complete
    one is the result (see :func:`read_last_batch`), so a crash in the middle
    of a write never costs the result before it."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()


def read_last_batch(spark: SparkSession, out_path: str, schema: T.StructType) -> DataFrame:
    """The result of the last batch that was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getParent().getName().split("=")[1])
            for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/batch=*/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out_path}/batch={max(done)}")


# ------------------------------------------------------------------ jobs
def ingest(stream: DataFrame, n: int | None = None) -> DataFrame:
    """Conform arriving records to the common schema (optionally bounded: any
    ``n`` records; for the first ones of each source see BoundedIngest)."""
    out = C.conform(C.with_int_score(stream))
    return out.limit(n) if n is not None else out


class BoundedIngest:
    """The first ``n`` records of each source, by (arrival batch, key), exactly.

    Each micro-batch knows how many records of a source earlier batches have
    admitted, marks the first of its own by key up to the rest of the bound (on
    the key column alone, see :func:`~..operators.sampling.mark_first`) and
    writes them to ``out_path/records/batch=<id>``, then the numbers admitted to
    ``out_path/admitted/batch=<id>``. Both are overwritten if Spark runs a batch
    again, and a batch counts only the numbers of batches before it, so a
    restart from the checkpoint neither loses nor repeats a record.

    Defined results: records without a key come behind all others of their
    batch; of records that share the last admitted key those with the smaller
    row hash are admitted; a null source is a source; an empty batch admits
    nothing. Sources are data sets: one number each reaches the driver.
    """

    def __init__(self, spark: SparkSession, out_path: str, n: int, source_col: str, key_col: str):
        self.spark, self.n, self.source, self.key = spark, n, source_col, key_col
        self.records, self.admitted = f"{out_path}/records", f"{out_path}/admitted"

    def _before(self, number: int) -> dict:
        """Admitted so far, by source, in the batches before ``number``."""
        schema = "source string, admitted long, batch long"
        known = read_or_empty(self.spark, self.admitted, T.StructType.fromDDL(schema))
        rows = known.where(F.col("batch") < number).groupBy("source").agg(F.sum("admitted").alias("n")).collect()
        return {r["source"]: r["n"] for r in rows}

    def write(self, batch: DataFrame, number: int) -> None:
        left = {s: max(0, self.n - k) for s, k in self._before(number).items()}
        source = F.coalesce(F.concat(F.lit("="), F.col(self.source).cast("string")), F.lit(""))  # null is a source
        rest = F.create_map(*[F.lit(x) for s, k in left.items() for x in ("" if s is None else f"={s}", k)]) if left else None

        def quota(by: Column, _) -> Column:
            return F.lit(self.n) if rest is None else F.coalesce(F.try_element_at(rest, by), F.lit(self.n))
        batch = batch.withColumn("ingest source", source)
        marked = mark_first(batch, quota, F.col(self.key), [self.key], "ingest first", by="ingest source")
        kept = marked.where("`ingest first`").drop("ingest first", "ingest source")
        path = f"{self.records}/batch={number}"
        kept.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(kept.schema).parquet(path)
        written.groupBy(F.col(self.source).cast("string").alias("source")).agg(
            F.count("*").alias("admitted")).write.mode("overwrite").parquet(f"{self.admitted}/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Take in all that has arrived; the records admitted up to now, with
        the batch they came in."""
        q = (stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return read_or_empty(self.spark, self.records, T.StructType(
            [*stream.schema.fields, T.StructField("batch", T.LongType())]))


def score(stream: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Stateless per-record scoring by a fitted Spark ML text model."""
    return ML.score_text(model, stream, text_col)


def quality_clean(stream: DataFrame, text_col: str = "text", lexicon=Q.DANISH_BLOCKED_WORDS,
                  threshold: int = Q.DEFAULT_THRESHOLD) -> DataFrame:
    """Clean records of the quality filter, on arrival."""
    ann = Q.annotate_quality(stream, text_col, lexicon, threshold)
    return ann.filter(~F.col("is_problematic")).drop(*Q.HELPER_COLUMNS)


def quality_split(spark: SparkSession, stream: DataFrame, name: str, text_col: str = "text",
                  lexicon=Q.DANISH_BLOCKED_WORDS,
                  threshold: int = Q.DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Annotate arriving records once and write them partitioned by verdict
    (one pass, both outputs, no filter in the streaming plan); returns the
    (clean, problematic) batch frames read back with partition pruning."""
    ann = Q.annotate_quality(stream, text_col, lexicon, threshold)
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    run_to_files(ann, out, ckpt, partition_by=["is_problematic"])
    back = spark.read.schema(ann.schema).parquet(out)
    clean = back.filter(~F.col("is_problematic")).drop(*Q.HELPER_COLUMNS)
    return clean, back.filter(F.col("is_problematic"))


def progress(annotations: DataFrame, id_col: str, label_col: str,
             event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Running label distribution where each item counts once.

    Without an event time the dedup state is the set of annotated ids
    (bounded by the annotation effort). With ``event_time`` and
    ``watermark`` (e.g. ``"7 days"``) a repeat of an id is only recognised
    within the watermark delay, and state older than it is dropped.
    """
    if event_time is not None:
        deduped = (annotations.withWatermark(event_time, watermark or "1 day")
                   .dropDuplicatesWithinWatermark([id_col]))
    else:
        deduped = annotations.dropDuplicates([id_col])
    return deduped.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def annotations_from_scores(stream: DataFrame) -> DataFrame:
    return stream.select("doc_id", decode_code("int_score").alias("our_label"))


def materialise(spark: SparkSession, plan: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """Run a streaming plan into the shared checkpoint folder and return the
    batch frame read back from its sink."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    if complete:
        run_complete_to_table(plan, out, ckpt)
        return read_last_batch(spark, out, plan.schema)
    run_to_files(plan, out, ckpt)
    return spark.read.schema(plan.schema).parquet(out)
