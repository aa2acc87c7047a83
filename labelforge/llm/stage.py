"""Intermediate tables in the cluster's shared folder, and batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it back:
    one pass, lineage cut, and nothing is lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that holds whole texts. A batch is built in full in the
#: JVM and again in Python, so its size is memory that every running task needs.
TEXT_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch to TEXT_ROWS rows if it
    is larger; operators call it before they hand texts to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df
