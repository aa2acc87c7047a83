"""Distributed model fitting with Spark ML (the reference fine-tunes a text
regressor with a frozen encoder, i.e. fits a small head on fixed
embeddings; and a class-weighted classifier)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def class_weights(train: DataFrame, label_col: str) -> DataFrame:
    """Inverse-frequency weights ``total / (K * n_c)`` over the observed
    classes K of the training rows (one row per class)."""
    c = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over <= K aggregated rows
    return c.select(label_col, "n",
                    (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def _features(df: DataFrame, array_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def fit_regressor(train: DataFrame, array_col: str, label_col: str, reg: float = 0.0):
    """Least-squares head on fixed embeddings (a frozen encoder's output),
    fitted distributively by Spark ML."""
    from pyspark.ml.regression import LinearRegression
    lr = LinearRegression(featuresCol="features", labelCol=label_col, regParam=reg,
                          solver="l-bfgs", maxIter=100)
    return lr.fit(_features(train, array_col).select("features", F.col(label_col).cast("double")))


def predict(model, df: DataFrame, array_col: str) -> DataFrame:
    return model.transform(_features(df, array_col)).drop("features")


def fit_weighted_classifier(train: DataFrame, array_col: str, label_col: str, weights: DataFrame):
    """Multinomial logistic regression with inverse-frequency class weights
    (broadcast join of the <= K-row weight table)."""
    from pyspark.ml.classification import LogisticRegression
    t = _features(train, array_col).join(F.broadcast(weights.select(label_col, "weight")), label_col)
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="weight",
                            family="multinomial", maxIter=100)
    return lr.fit(t.select("features", F.col(label_col).cast("double").alias(label_col), "weight"))


def gram_parts(df: DataFrame, array_col: str, label_col: str, dim: int, by: str) -> dict:
    """Per value of ``by`` the matrix Z'Z of the rows z = (x, 1, y): with it any
    least-squares head on x, for y's mean and for any union of the parts, whose
    matrix is the sum of theirs.

    Tasks add up their rows' products; what moves is (dim + 2)^2 sums a task and
    part, what reaches the driver (dim + 2)^2 sums a part. Rows without a label,
    with another length than ``dim`` or with a component that is null or not
    finite take no part."""
    import numpy as np
    size = dim + 2

    def products(batches):
        sums: dict = {}
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
            z = np.column_stack((x, np.ones(len(x)), np.asarray(batch.column(2), dtype=np.float64)))
            parts = np.asarray(batch.column(0))
            for part in np.unique(parts).tolist():
                mine = z[parts == part]
                sums[part] = sums.get(part, 0) + mine.T @ mine
        at = pa.array(list(range(size * size)), pa.int32())
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(at), pa.int64()), at, pa.array(total.reshape(-1))], names=["part", "at", "v"])
    x = F.col(array_col).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    y = F.col(label_col).cast("double")
    rows = df.where(F.col(by).isNotNull() & y.isNotNull() & (F.size(x) == dim) & whole).select(
        F.col(by).cast("long"), x.alias("x"), y.alias("y"))
    found = (rows.mapInArrow(products, "part long, at int, v double")
             .groupBy("part", "at").agg(F.sum("v").alias("v")).collect())
    out: dict = {}
    for r in found:
        out.setdefault(r["part"], np.zeros(size * size))[r["at"]] = r["v"]
    return {k: v.reshape(size, size) for k, v in out.items()}


def solve_head(gram, reg: float = 1.0) -> list[float]:
    """Weights and intercept of least squares with ``reg`` times the squared
    weights (not the intercept) added."""
    import numpy as np
    a = np.array(gram[:-1, :-1])
    a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += reg
    return np.linalg.solve(a, gram[:-1, -1]).tolist()


def apply_head(weights: list[float], array_col: str) -> Column:
    """The head's output; null for a row whose vector has another length."""
    x = F.col(array_col).cast("array<double>")
    terms = F.zip_with(x, F.array(*[F.lit(w) for w in weights[:-1]]), lambda a, b: a * b)
    return F.when(F.size(x) == len(weights) - 1, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) + weights[-1])


MAX_TOKENS = 512
PROFILE = 16


def first_tokens(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The first ``max_tokens`` tokens of a text (whitespace runs, as
    ``str.split``): truncation for models with a bounded input."""
    from ..functions.text import py_split
    return F.slice(py_split(text), 1, max_tokens)


def token_profile(text: Column, max_tokens: int = MAX_TOKENS, dim: int = PROFILE) -> Column:
    """A small vector of a text's first tokens: the share of those with 1, 2, ...
    characters, the last place for ``dim`` or more. Zeros without tokens."""
    lengths = F.transform(first_tokens(text, max_tokens), lambda t: F.least(F.length(t), F.lit(dim)))

    def shares(k: Column) -> Column:  # of the lengths, which are taken once
        of = lambda n: (F.size(k) - F.size(F.array_remove(k, n))) / F.greatest(F.size(k), F.lit(1))
        return F.array(*[of(n) for n in range(1, dim + 1)])
    return F.get(F.transform(F.array(lengths), shares), 0)


def fit_token_head(train: DataFrame, text_col: str, label_col: str, reg: float = 1.0,
                   max_tokens: int = MAX_TOKENS) -> list[float]:
    """A least-squares head on the token profiles of truncated texts; no rows
    give a head of zeros."""
    rows = train.select(token_profile(F.col(text_col), max_tokens).alias("x"), F.col(label_col).alias("y"),
                        F.lit(0).alias("part"))
    # stored, since filters on x would be pushed below it and evaluate it again
    parts = gram_parts(stored(rows, "profiles"), "x", "y", PROFILE, "part")
    return solve_head(parts[0], reg) if parts else [0.0] * (PROFILE + 1)


def score_tokens(weights: list[float], df: DataFrame, text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``score`` and ``int_score`` (clamp 0..5, half-even) to the rows with a
    non-empty text, by a head of :func:`fit_token_head`; a plain projection, for
    batch and streaming frames."""
    from ..functions.scores import score_to_int
    profile = token_profile(F.col(text_col), max_tokens)
    return (df.where(F.length(F.col(text_col)) > 0).withColumn("token profile", profile)
            .withColumn("score", apply_head(weights, "`token profile`")).drop("token profile")
            .withColumn("int_score", score_to_int("score")))


def fit_text_regressor(train: DataFrame, text_col: str, label_col: str, num_features: int = 1 << 16,
                       reg: float = 0.01):
    """Regression head on hashed whole-text token counts: native tokenizer
    (whitespace runs, as ``str.split``), HashingTF, least squares. The counts are
    stored: the fit reads its rows several times, and the texts once."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.regression import LinearRegression
    from ..functions.text import SPLIT_RE
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=SPLIT_RE, gaps=True,
                         toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="features", numFeatures=num_features)
    lr = LinearRegression(featuresCol="features", labelCol=label_col, regParam=reg, solver="l-bfgs", maxIter=30)
    rows = Pipeline(stages=[tok, tf]).fit(train).transform(train.select(text_col, F.col(label_col).cast("double")))
    return PipelineModel([tok, tf, lr.fit(stored(rows.select("features", label_col), "features"))])


def score_text(model, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``score`` (the fitted text model's output) and ``int_score`` (clamp
    0..5, half-even) to the rows with a non-empty text; works on batch and
    streaming frames."""
    from ..functions.scores import score_to_int
    keep = df.columns
    return (model.transform(df.where(F.length(F.col(text_col)) > 0))
            .select(*keep, F.col("prediction").alias("score"))
            .withColumn("int_score", score_to_int("score")))
