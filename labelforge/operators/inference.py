"""Batched model inference as Arrow-batched pandas UDFs.

A model is supplied as a *factory* ``() -> Callable[[pd.Series], pd.Series]``
that is called once per Python worker task (iterator UDF), so weights or a
client are created once and reused for every Arrow batch of the partition.
Null / blank texts never reach the model. No weights or clients ship with this
repository: the factory is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from ..functions.text import col_of

ModelFactory = Callable[[], Callable[[pd.Series], pd.Series]]

# Models built in this Python worker, by the factory's ``cache_key``. Spark
# reuses Python workers across tasks, so a keyed model (weights, a client)
# is built once per worker rather than once per task.
_WORKER_MODELS: dict = {}


def keyed(factory: ModelFactory, key: str) -> ModelFactory:
    """Mark a factory as cacheable per worker under ``key``."""
    factory.cache_key = key  # type: ignore[attr-defined]
    return factory


def load_model(factory: ModelFactory):
    key = getattr(factory, "cache_key", None)
    if key is None:
        return factory()
    if key not in _WORKER_MODELS:
        _WORKER_MODELS[key] = factory()
    return _WORKER_MODELS[key]


def render_prompt(text_col, head: str, tail: str) -> Column:
    """Rubric prompt = head + text + tail (native concat)."""
    return F.concat(F.lit(head), F.coalesce(col_of(text_col), F.lit("")), F.lit(tail))


def with_retries(factory: ModelFactory, attempts: int = 3, fallback=None) -> ModelFactory:
    """Wrap a model/client factory so each batch is retried up to
    ``attempts`` times; after that its rows are tried one by one, and only
    the rows that fail alone yield ``fallback`` (for the LLM scorer an empty
    response, i.e. score -1) instead of failing the task."""
    def wrapped():
        model = factory()

        def call(batch: pd.Series) -> pd.Series:
            for _ in range(attempts):
                try:
                    return model(batch)
                except Exception:  # noqa: BLE001 - remote/model errors are retried
                    continue
            if len(batch) == 1:
                return pd.Series([fallback], index=batch.index, dtype=object)
            return pd.concat([call(batch.iloc[i:i + 1]).astype(object) for i in range(len(batch))])
        return call
    key = getattr(factory, "cache_key", None)
    return keyed(wrapped, f"retries:{attempts}:{key}") if key is not None else wrapped


# ------------------------------------------------------------- UDF glue
def _batched(factory: ModelFactory, out_type: T.DataType, batch_size: int, blank=None):
    """``blank`` is the result for an empty text; a null text stays null."""
    @F.pandas_udf(out_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model(factory)  # once per worker when keyed, else per task
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[texts == ""] = blank
            ok = texts.notna() & (texts.str.len() > 0)
            if ok.any():
                todo = texts[ok]
                parts = [model(todo.iloc[i:i + batch_size]) for i in range(0, len(todo), batch_size)]
                out[ok] = pd.concat(parts).values
            yield out.astype("float64") if isinstance(out_type, T.DoubleType) else out
    return run


def model_udf(factory: ModelFactory, batch_size: int = 32):
    """The regression model as a column function (double output)."""
    return _batched(factory, T.DoubleType(), batch_size)


def classify(df: DataFrame, text_col: str, factory: ModelFactory, batch_size: int = 32) -> DataFrame:
    """Add ``score`` (model output) and ``int_score`` (clamp 0..5, half-even);
    rows with null/empty text are skipped, all other columns kept."""
    udf = _batched(factory, T.DoubleType(), batch_size)
    return (df.filter(F.length(F.col(text_col)) > 0)
            .withColumn("score", udf(F.col(text_col)))
            .withColumn("int_score", S.score_to_int("score")))


def translate(df: DataFrame, input_col: str, output_col: str, factory: ModelFactory,
              batch_size: int = 32) -> DataFrame:
    """Add ``output_col`` with the translation; nulls stay null."""
    return df.withColumn(output_col, _batched(factory, T.StringType(), batch_size, "")(F.col(input_col)))


def llm_score(df: DataFrame, text_col: str, head: str, tail: str,
              factory: ModelFactory, batch_size: int = 8) -> DataFrame:
    """Render the rubric prompt, ask the client per batch, keep the raw
    response and parse the score (blank text -> -1 without a call)."""
    factory = with_retries(factory)
    udf = _batched(factory, T.StringType(), batch_size)
    blank = S.is_blank(text_col)
    # Python UDFs run for every row of the batch, even under CASE WHEN, so
    # blank texts get a null prompt, which the batch wrapper never sends.
    prompt = F.when(blank, F.lit(None).cast("string")).otherwise(render_prompt(text_col, head, tail))
    resp = udf(prompt)
    out = df.withColumn("response", resp).withColumn(
        "score", F.when(blank, F.lit(S.LLM_FAILED)).otherwise(S.parse_llm_score("response")))
    # the raw integer is kept; whether it lies on the rubric's scale is a
    # separate quality column
    return out.withColumn("score_in_range", F.col("score").between(0, 5))

