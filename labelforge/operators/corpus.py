"""Corpus assembly: conform sources to a common schema, bounded per-source
ingest, merging, class balancing and score distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from . import sampling

# --- fixed values -----------------------------------------------------------
COMMON_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("language_score", T.DoubleType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("int_score", T.IntegerType()),
])
# ---------------------------------------------------------------------------


def require_columns(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType = COMMON_SCHEMA) -> DataFrame:
    """Project onto ``schema``: present columns are cast, absent ones null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType = COMMON_SCHEMA) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(frames: list[DataFrame], spark: SparkSession | None = None,
              schema: T.StructType = COMMON_SCHEMA) -> DataFrame:
    """UNION ALL by name; missing columns become null; no frames -> empty."""
    if not frames:
        if spark is None:
            raise ValueError("no frames and no session for the empty result")
        return empty(spark, schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_int_score(df: DataFrame) -> DataFrame:
    """Derive ``int_score`` from ``score`` only where it is absent."""
    if "score" not in df.columns:
        return df
    if "int_score" in df.columns:
        return df.withColumn("int_score", S.int_score_fallback("int_score", "score"))
    return df.withColumn("int_score", S.score_to_int("score"))


def bounded_ingest(df: DataFrame, n: int, order_col: str,
                   schema: T.StructType = COMMON_SCHEMA) -> DataFrame:
    """First ``n`` rows (by key) of one source, in the common schema."""
    return conform(with_int_score(sampling.first_n(df, n, order_col)), schema)


def merge_sources(sources: list[tuple[str, DataFrame, int]], order_col: str,
                  spark: SparkSession | None = None) -> DataFrame:
    """Bounded ingest of each (name, frame, n) (n = -1: all), conform,
    union, with a ``source_name`` provenance column."""
    parts = []
    for name, df, n in sources:
        part = df if n < 0 else sampling.first_n(df, n, order_col)
        parts.append(conform(with_int_score(part)).withColumn("source_name", F.lit(name)))
    return union_all(parts, spark)


def merge_training_set(sources: list[tuple[DataFrame, int]], id_col: str, seed: int = 42,
                       spark: SparkSession | None = None) -> DataFrame:
    """Seeded exact sample of ``min(n, len)`` rows per source (-1 all, 0 skip)."""
    parts = [sampling.sample_n(df, n, id_col, seed) for df, n in sources if n != 0]
    return union_all(parts, spark)


def score_distribution(spark: SparkSession, df: DataFrame, col: str = "int_score",
                       domain=range(6)) -> DataFrame:
    """Count per value over a fixed domain, zeros included."""
    counts = df.groupBy(F.col(col).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    dom = spark.createDataFrame([(int(v),) for v in domain], "score int")
    return (dom.join(F.broadcast(counts.filter(F.col("score").isin(list(domain)))), "score", "left")
            .select("score", F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def merge_top_class(df: DataFrame, col: str = "int_score", top: int = 5, into: int = 4) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == top, F.lit(into)).otherwise(F.col(col)))
