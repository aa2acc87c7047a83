"""File sources and sinks with pandas-compatible semantics.

CSV: RFC-4180 quoting (``"`` escapes ``"``), multi-line quoted text, header,
no whitespace trimming on write, explicit schema on read (no inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .ranges import read_csv_ranges, read_json_array_ranges

CSV_OPTS = {"header": "true", "escape": '"', "quote": '"', "multiLine": "true",
            "encoding": "UTF-8"}
CSV_WRITE_OPTS = {"header": "true", "escape": '"', "quote": '"',
                  "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                  "encoding": "UTF-8"}
RECORD = "_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, by_ranges: bool = False) -> DataFrame:
    """CSV files, one task each; with ``by_ranges`` a file is read by as many
    tasks as it has byte ranges (see :mod:`.ranges`), for files too large for
    one."""
    if by_ranges:
        return read_csv_ranges(spark, path, schema, CSV_OPTS)
    return spark.read.options(**CSV_OPTS).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_WRITE_OPTS).csv(path)


def read_csv_skip_long_rows(spark: SparkSession, path: str, schema: T.StructType,
                            header: bool = True) -> DataFrame:
    """Rows with *more* fields than the schema are dropped; rows with fewer
    are kept and padded with nulls (pandas ``on_bad_lines='skip'``).

    The CSV parser itself (quotes, embedded commas and newlines) hands over
    the record of every row whose field count is not the schema's; its commas
    outside quotes tell whether it has too many, also when the surplus field
    is empty.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                       + [T.StructField(RECORD, T.StringType())])
    df = (spark.read.options(**CSV_OPTS).option("header", str(header).lower())
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).schema(raw).csv(path))
    commas = F.length(F.regexp_replace(F.regexp_replace(F.col(RECORD), r'"(?:[^"]|"")*"', ""), "[^,]", ""))
    df = df.filter(F.col(RECORD).isNull() | (commas < len(schema.fields)))
    # empty -> null as pandas reads it; then the declared types
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, by_ranges: bool = False) -> DataFrame:
    """Files that hold one JSON array of records each, one task a file; with
    ``by_ranges`` one task a byte range (see :mod:`.ranges`)."""
    if by_ranges:
        return read_json_array_ranges(spark, path, schema)
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append new records to a dataset directory (no read-modify-rewrite)."""
    df.write.mode("append").format(fmt).save(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a dataset, or an empty frame with ``schema`` when the path does
    not exist; every other error surfaces."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex) or "Path does not exist" in str(ex):
            return spark.createDataFrame([], schema)
        raise


def jsonl_to_csv(spark: SparkSession, jsonl_path: str, csv_path: str, text_col: str = "text",
                 score_col: str = "gemini_prediction", out_score: str = "int_score") -> None:
    """Project a JSONL predictions file to ``text, int_score`` CSV."""
    schema = T.StructType([T.StructField(text_col, T.StringType()),
                           T.StructField(score_col, T.LongType())])
    df = read_json_lines(spark, jsonl_path, schema)
    write_csv(df.select(text_col, F.col(score_col).cast("int").alias(out_score)), csv_path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Corpus layout for subset loads: one directory per value of ``by``
    (e.g. language, snapshot), so ``filter(lang = ...)`` prunes directories
    instead of reading every file. Rows are clustered by the partition
    columns first so each task writes few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def read_subset(spark: SparkSession, path: str, **equals) -> DataFrame:
    """Read a partitioned corpus restricted to partition values."""
    df = spark.read.parquet(path)
    for k, v in equals.items():
        df = df.filter(F.col(k) == v)
    return df
