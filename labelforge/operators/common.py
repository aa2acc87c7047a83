"""Shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from it.

    Used where one intermediate feeds several branches of a plan (a small
    aggregate, or a per-item count table feeding several statistics): the
    work below it runs once, and lineage is cut, so a lost executor re-reads
    stored blocks instead of recomputing the upstream stages.
    """
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: one job (a checkpoint runs two), columns stay prunable."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
