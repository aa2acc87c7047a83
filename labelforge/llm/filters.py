"""Corpus stages: documents in, documents out, by the operators' decisions.

Defined results of all stages: a null text counts as an empty one and stays
null; rows that are there several times are judged alike; an empty table gives
no rows; a stage that returns documents passes every column on as it came, also
one that is named like a column of an operator (``own_columns``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import decontaminate, neardup, packing, suffixes, toxicity
from .stage import stage

TOXIC_FROM = 0.3
NEAR_COPY_WORDS, NEAR_COPY_PERCENT = 5, 80


def own_columns(stage_: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Runs a stage with the columns it does not know under names that no
    operator uses, and gives them their names back."""
    @wraps(stage_)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, *more) -> DataFrame:
        known = {"doc_id", "text", "n_chars"}
        names = {c: f"passed on {i}" for i, c in enumerate(docs.columns) if c.lower() not in known}
        out = stage_(spark, docs.withColumnsRenamed(names), sf_dir, *more)
        return out.withColumnsRenamed({v: k for k, v in names.items()})
    return run


@own_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_FROM; those without text or id as well.
    Labels of a document that is not in ``docs`` are not used."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC_FROM).select(
        *[F.col(f"`{c}`") for c in docs.columns])


@own_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingle sets with a
    similarity of NEAR_COPY_PERCENT or more), the one with the smallest id. A
    row that is there several times stays once; an id with several texts goes
    only if no row of it stays; rows without an id or without words stay.

    The texts are shuffled once, whatever the number of copies: what is
    special about an id is joined to them by a sort-merge join."""
    found = neardup.near_duplicates(
        docs.select("doc_id", "text"), NEAR_COPY_WORDS, NEAR_COPY_PERCENT, 100).where(F.col("doc_id").isNotNull())
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("copy kept"), F.count("*").alias("copy rows"))
    special = stage(ids.where(~F.col("copy kept") | (F.col("copy rows") > 1)), "copies")
    marked = docs.join(special.hint("merge"), "doc_id", "left").where(F.coalesce("copy kept", F.lit(True)))
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    several = marked.where(F.col("copy rows") > 1).withColumn("copy number", first).where("`copy number` = 1")
    return marked.where(F.coalesce("copy rows", F.lit(1)) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(
        several.select(*[F.col(f"`{c}`") for c in docs.columns]))


@own_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand further up already: in a
    document with a smaller id, or in the same one. Rows without an id come
    first of all; rows with one id and one text are cut alike."""
    found = suffixes.find_repeats(docs, as_text=True)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


@own_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; each row is judged by
    itself, and texts without words stay."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


@own_columns
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str) -> DataFrame:
    """The pieces of all documents in sequences; the documents' other columns
    are not returned. A row without text is one end token; rows that repeat are
    packed as often as they are there."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary)
