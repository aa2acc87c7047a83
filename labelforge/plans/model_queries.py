"""Model-fitting jobs (Spark ML) on ``embeddings`` and on document text with
``labels``. Fitted coefficients depend on the optimiser, so the oracles check
exact counts per split and that the model beats the mean (or majority)
predictor. Heads in closed form (``embedding_head``, ``learning_curve``) are
compared number by number with the normal equations solved in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import discretize
from ..functions.text import SPLIT_RE
from ..operators import metrics as MT
from ..operators import ml as ML
from ..operators import sampling as R
from ..operators.common import materialise
from ..sources.tables import documents, embeddings, table
from .registry import register

SIZES = (250, 1000, 2500)


def _split(df, id_col, seed=42):
    """Seeded exact 80/20 split, written once: the fits read it many times."""
    return materialise(R.train_val_split(df, 0.2, id_col, seed))


def labelled_quality(spark, sf):
    labels = table(spark, sf, "labels").where(F.col("quality").isNotNull()).select("doc_id", "quality")
    return documents(spark, sf).select("doc_id", "text").join(labels, "doc_id")


def fitted_quality(spark, sf, num_features: int = 1 << 12):
    """A text regressor of the quality label, fitted on all labelled rows."""
    rows = labelled_quality(spark, sf).where(F.length("text") > 0)
    return ML.fit_text_regressor(rows, "text", "quality", num_features=num_features, reg=0.1)


def _split_sql(rows, key):
    return f"""SELECT CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split, count(*) AS n,
      CASE WHEN any_value(r <= floor(0.8 * n)) THEN TRUE END AS beats_mean
    FROM (SELECT row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) AS r, count(*) OVER () AS n
          FROM {rows}) GROUP BY ALL"""


def _fit_report(pred, label):
    """n per split, and on the rows of the fit whether the squared error is
    below that of their mean."""
    err = F.pow(F.col("prediction") - F.col(label), 2)
    g = pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mse"),
                                  F.var_pop(F.col(label).cast("double")).alias("var"))
    return g.select("split", "n", F.when(F.col("split") == "train", F.col("mse") < F.col("var")).alias("beats_mean"))


@register("embedding_regressor", _split_sql("embeddings", "vec_id"))
def embedding_regressor(spark, sf):
    s = _split(embeddings(spark, sf).select("vec_id", "embedding", "label"), "vec_id")
    model = ML.fit_regressor(s.filter(F.col("split") == "train"), "embedding", "label")
    return _fit_report(ML.predict(model, s, "embedding"), "label")


@register("text_regressor", _split_sql("(SELECT doc_id FROM documents JOIN labels USING (doc_id) "
                                       "WHERE quality IS NOT NULL)", "doc_id"))
def text_regressor(spark, sf):
    """Quality regressor on whole texts (hashed tokens)."""
    s = _split(labelled_quality(spark, sf), "doc_id")
    model = ML.fit_text_regressor(s.filter(F.col("split") == "train"), "text", "quality", num_features=1 << 12, reg=0.1)
    return _fit_report(model.transform(s), "quality")


@register("weighted_classifier", """SELECT 'weighted_logreg' AS model_name, count(*) AS n, TRUE AS beats_chance
    FROM (SELECT row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS r, count(*) OVER () AS n
          FROM embeddings) WHERE r <= floor(0.8 * n)""")
def weighted_classifier(spark, sf):
    """Class-weighted classifier: on the rows of the fit its mean recall per
    class is above one over the number of classes."""
    s = _split(embeddings(spark, sf).select("vec_id", "embedding", "label"), "vec_id")
    train = s.filter(F.col("split") == "train")
    model = ML.fit_weighted_classifier(train, "embedding", "label", ML.class_weights(train, "label"))
    per = ML.predict(model, train, "embedding").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("recall"))
    return per.agg(F.sum("n").alias("n"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("k")).select(
        F.lit("weighted_logreg").alias("model_name"), "n", (F.col("recall") > 1 / F.col("k")).alias("beats_chance"))


DIM = 64  # of the embeddings
REG = 1.0


_EMBEDDED_SQL = """e AS (SELECT vec_id, label / 2.0 AS y, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS r,
      floor(0.8 * count(*) OVER ()) AS n_train, list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 1.0) AS x
      FROM embeddings)"""


def _heads_sql(sizes: str, rows: str = _EMBEDDED_SQL, dim: int = DIM) -> str:
    """Heads w per size s, by Gauss-Jordan elimination of the regularised normal
    equations: m holds one row of (X'X | X'y) per unknown. ``rows`` names the
    rows e: x, y, and their number r of n_train."""
    return f"""{rows},
    sizes AS (SELECT unnest({sizes}) AS s),
    fit AS (SELECT s, x, list_append(x, y) AS z FROM e, sizes WHERE r <= least(s, n_train)),
    g AS (SELECT s, i, j, sum(x[i] * z[j]) + CASE WHEN i = j AND i <= {dim} THEN {REG} ELSE 0 END AS v
          FROM fit, (SELECT unnest(range(1, {dim + 2})) AS i), (SELECT unnest(range(1, {dim + 3})) AS j) GROUP BY s, i, j),
    rows_ AS (SELECT s, i, list(v ORDER BY j) AS a FROM g GROUP BY s, i),
    elim AS (SELECT s, 0 AS k, list(a ORDER BY i) AS m FROM rows_ GROUP BY s
      UNION ALL SELECT s, k + 1, list_transform(m, lambda a, i: CASE WHEN i = k + 1 THEN list_transform(a, lambda v: v / m[k + 1][k + 1])
        ELSE list_transform(a, lambda v, j: v - a[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM elim WHERE k <= {dim}),
    w AS (SELECT s, list_transform(m, lambda a: a[{dim + 2}]) AS w FROM elim WHERE k = {dim + 1})"""


def _embedded(spark, sf):
    """Vectors with a label of half steps, in the seeded order of the split."""
    v = embeddings(spark, sf).select("vec_id", "embedding", (F.col("label") / 2).alias("y"))
    return R.train_val_split(v, 0.2, "vec_id", 42)


@register("embedding_head", f"""WITH RECURSIVE {_heads_sql("[1000000000000]")}
    SELECT CAST(i AS INTEGER) AS place, round(w[i], 6) + 0.0 AS weight FROM w, (SELECT unnest(range(1, {DIM + 2})) AS i)""")
def embedding_head(spark, sf):
    """Weights and intercept of a regularised head on the embeddings of the
    train split, in closed form."""
    train = _embedded(spark, sf).where("split = 'train'").withColumn("part", F.lit(0))
    parts = ML.gram_parts(train, "embedding", "y", DIM, "part")
    weights = ML.solve_head(parts[0], REG) if parts else []
    return spark.createDataFrame(list(enumerate(weights, 1)), "place int, weight double").select(
        "place", (F.round("weight", 6) + 0.0).alias("weight"))


@register("learning_curve", f"""WITH RECURSIVE {_heads_sql(str(list(SIZES)))},
    p AS (SELECT s, y, list_sum(list_transform(x, lambda v, i: v * w[i])) AS q FROM e, w WHERE r > n_train),
    c AS (SELECT s, y, q, CAST(greatest(0, least(4, round_even(q, 0))) AS INTEGER) AS pc,
            CAST(greatest(0, least(4, round_even(y, 0))) AS INTEGER) AS lc FROM p),
    l AS (SELECT s, lc AS label, 1 AS support, 0 AS predicted, CASE WHEN lc = pc THEN 1 ELSE 0 END AS tp FROM c
      UNION ALL SELECT s, pc, 0, 1, 0 FROM c),
    k AS (SELECT s, label, sum(support) AS n, sum(predicted) AS pr, sum(tp) AS tp FROM l GROUP BY s, label),
    f AS (SELECT s, avg(coalesce(tp / nullif(pr, 0), 0)) AS precision, avg(coalesce(tp / nullif(n, 0), 0)) AS recall,
            avg(coalesce(2 * tp / nullif(n + pr, 0), 0)) AS f1_macro FROM k GROUP BY s),
    a AS (SELECT s, avg(CASE WHEN lc = pc THEN 1.0 ELSE 0.0 END) AS accuracy, avg(power(y - q, 2)) AS mse FROM c GROUP BY s)
    SELECT CAST(s AS INTEGER) AS n_samples, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy, round(mse, 6) AS mse FROM f JOIN a USING (s)""")
def learning_curve(spark, sf):
    """Heads on nested seeded samples of the train split; precision, recall, F1,
    accuracy and MSE of each on the validation split. The samples' matrices are
    sums of those of the bands between them, so all heads come from one pass."""
    s = _embedded(spark, sf)
    train = s.where("split = 'train'").drop("split")
    band = F.lit(None).cast("int")
    for k, n in reversed(list(enumerate(SIZES))):
        train = R.mark_first(train, n, R.hash_ordinal("vec_id", 42), [R.hash_key("vec_id", 42), "vec_id"], f"first{k}",
                             top=R.HASH_TOP)
        band = F.when(F.col(f"first{k}"), k).otherwise(band)
    parts = ML.gram_parts(train.withColumn("band", band), "embedding", "y", DIM, "band")
    rows, total = None, 0
    held_out = s.where("split = 'validation'")
    for k, n in enumerate(SIZES):
        total = total + parts[k] if k in parts else total
        pred = held_out.withColumn("q", ML.apply_head(ML.solve_head(total, REG), "embedding"))
        r = MT.regression_eval(pred, "q", "y").withColumn("n_samples", F.lit(n))
        rows = r if rows is None else rows.unionByName(r)
    return rows.select("n_samples", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_macro", "accuracy", "mse")])


_PROFILE_SQL = f"""tok AS (SELECT doc_id, list_slice(list_filter(regexp_split_to_array(text, '{SPLIT_RE}'), lambda t: t <> ''),
        1, {ML.MAX_TOKENS}) AS t FROM documents WHERE length(text) > 0),
    prof AS (SELECT doc_id, list_append(list_transform(range(1, {ML.PROFILE + 1}), lambda k:
        len(list_filter(t, lambda x: least(length(x), {ML.PROFILE}) = k)) / greatest(len(t), 1)), 1.0) AS x FROM tok),
    e AS (SELECT x, CAST(quality AS DOUBLE) AS y, 0 AS r, 0 AS n_train FROM prof JOIN labels USING (doc_id)
          WHERE quality IS NOT NULL)"""

#: Scores of all non-empty documents by the head fitted on the labelled ones.
TOKEN_SCORES_SQL = f"""WITH RECURSIVE {_heads_sql("[0]", _PROFILE_SQL, ML.PROFILE)},
    q AS (SELECT doc_id, list_sum(list_transform(x, lambda v, i: v * w[i])) AS q FROM prof, w)
    SELECT doc_id, round(q, 6) + 0.0 AS score, CAST(greatest(0, least(5, round_even(q, 0))) AS INTEGER) AS int_score FROM q"""


def token_head(spark, sf):
    """The head of the quality label on the first tokens of labelled texts."""
    rows = labelled_quality(spark, sf).where(F.length("text") > 0)
    return ML.fit_token_head(rows, "text", "quality", REG)


@register("regression_confusion", """SELECT CAST(greatest(0, least(4, round_even(true_label, 0))) AS INTEGER) AS true_class,
    CAST(greatest(0, least(4, round_even(raw_prediction_full_finetune, 0))) AS INTEGER) AS predicted_class, count(*) AS n
    FROM v_preds_wide GROUP BY ALL""", ("v_preds_wide",))
def regression_confusion(spark, sf):
    """Confusion counts of the discretised regression outputs."""
    from ..sources import fixtures as V
    w = V.v_preds_wide(spark, sf)
    return w.groupBy(discretize("true_label").alias("true_class"),
                     discretize("raw_prediction_full_finetune").alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))
