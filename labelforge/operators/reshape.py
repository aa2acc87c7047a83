"""Reshaping: wide model columns <-> long rows, list expansion, averages,
histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import json_list

PRED_PREFIX = "predicted_label_"
RAW_PREFIX = "raw_prediction_"


def model_names(df: DataFrame, prefix: str = PRED_PREFIX) -> list[str]:
    """Model names from column names (schema-time, no data read)."""
    return [c[len(prefix):] for c in df.columns if c.startswith(prefix)]


def wide_to_long(df: DataFrame, keep: list[str], prefix: str = PRED_PREFIX,
                 raw_prefix: str = RAW_PREFIX) -> DataFrame:
    """One row per (input row, model): ``model_name``, ``final_prediction``,
    ``raw_prediction`` (null when the model has no raw column). One scan:
    ``inline`` over an array of per-model structs."""
    structs = []
    for m in model_names(df, prefix):
        raw = (F.col(raw_prefix + m).cast("double") if raw_prefix + m in df.columns
               else F.lit(None).cast("double"))
        structs.append(F.struct(F.lit(m).alias("model_name"),
                                F.col(prefix + m).cast("int").alias("final_prediction"),
                                raw.alias("raw_prediction")))
    return df.select(*keep, F.inline(F.array(*structs)))


def long_to_wide(long: DataFrame, key: str, models: list[str], value: str = "final_prediction",
                 model_col: str = "model_name") -> DataFrame:
    """One column per model (explicit pivot values: no extra distinct job)."""
    return long.groupBy(key).pivot(model_col, models).agg(F.first(value))


def expand_list(df: DataFrame, column: str, prefix: str, width: int | None = None,
                rename: dict[str, str] | None = None) -> DataFrame:
    """JSON-list text column -> ``prefix_0..prefix_{w-1}`` doubles (bad JSON ->
    empty list, non-numeric -> null). Width = longest list unless given."""
    arr = json_list(column)
    if width is None:
        width = df.select(F.max(F.size(arr)).alias("w")).first()["w"] or 0
    rename = rename or {}
    cols = [F.get(arr, i).try_cast("double").alias(rename.get(f"{prefix}_{i}", f"{prefix}_{i}"))
            for i in range(width)]
    return df.select(*[c for c in df.columns if c != column], *cols)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name not in set(exclude) and isinstance(f.dataType, T.NumericType)]


def column_averages(df: DataFrame, exclude=()) -> DataFrame:
    """(column, mean) for every numeric column not excluded — one aggregate."""
    cols = numeric_columns(df, exclude)
    wide = df.agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "mean")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] with numpy's binning rule:
    edges ``lo + i * (hi - lo) / bins`` (last edge = hi), index
    ``floor((x - lo) * (bins / (hi - lo)))`` corrected by one when x falls
    below its edge or on the next one, last bin closed. min/max are one tiny
    aggregate; the counts are one partial/final aggregate on the bin. Null and
    NaN values take no part; without any value the result is empty."""
    df = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = float(r["lo"]), float(r["hi"])
    if hi == lo:  # numpy widens a zero range to +-0.5
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    x = F.col(col).cast("double")

    def edge(i):
        return F.when(i == bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))
    i0 = F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int")
    i1 = F.when(i0 == bins, F.lit(bins - 1)).otherwise(i0)
    i2 = F.when(x < edge(i1), i1 - 1).otherwise(i1)
    i3 = F.when((x >= edge(i2 + 1)) & (i2 != bins - 1), i2 + 1).otherwise(i2)
    counts = df.groupBy(i3.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame(
        [(i, i * step + lo, hi if i + 1 == bins else (i + 1) * step + lo) for i in range(bins)],
        "bin int, bin_lo double, bin_hi double")
    return edges.join(F.broadcast(counts), "bin", "left").select(  # <= bins rows
        "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"))
