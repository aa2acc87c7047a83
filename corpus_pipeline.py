"""Training-corpus pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut out, documents with benchmark passages go, and what is left
is packed into sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import filters
from labelforge.llm.queries import vocabulary
from labelforge.llm.stage import stage
from labelforge.sources.tables import table


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.pack(spark, docs, sf_dir, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", filters.drop_toxic),
    ("near_dedup", filters.drop_near_copies),
    ("suffix_dedup", filters.cut_repeats),
    ("decontamination", filters.drop_contaminated),
    ("packing", pack),
]

#: The classifier, the signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
