"""Classifier-evaluation metrics from one contingency aggregate.

``contingency`` is the only data-sized step: a partial/final hash aggregate
``(model, true, pred) -> n, squared errors``. Everything after it works on at
most models x K^2 rows. Label domains follow scikit-learn: macro averages run
over the union of labels seen in truth or prediction (a stray -1 or 5 adds a
class with F1 0); the report and fixed-label confusion matrix use 0..4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import LABEL_CODES
from .common import materialise

REPORT_LABELS = list(LABEL_CODES.values())
TARGET_NAMES = list(LABEL_CODES)

M, T, P, RAW = "model_name", "true_label", "final_prediction", "raw_prediction"


def materialise_small(df: DataFrame) -> DataFrame:
    """Checkpoint a small aggregated frame (<= models x K^2 rows) that feeds
    several branches, so the data-sized plan under it runs once."""
    return materialise(df)


def _safe_div(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def drop_sentinels(long: DataFrame, lo: int = 0, hi: int = 4) -> DataFrame:
    """Optional: leave out predictions outside the label domain (an LLM's
    -1 "failed" or a 0-5 scale's 5). By default they are kept and count as
    classes, as in the reference's evaluation."""
    return long.filter(F.col(P).between(lo, hi))


def contingency(long: DataFrame) -> DataFrame:
    """(model, true, pred) -> n, sum (t - raw)^2, count(raw), sum (t - pred)^2."""
    t, p = F.col(T).cast("double"), F.col(P).cast("double")
    return long.groupBy(M, T, P).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(t - F.col(RAW), 2)).alias("se_raw"),
        F.count(RAW).alias("n_raw"),
        F.sum(F.pow(t - p, 2)).alias("se_pred"))


def per_class(cm: DataFrame) -> DataFrame:
    """Per (model, label): support, predicted, tp, precision, recall, f1 over
    the observed label union. Each contingency cell is counted once on its
    true label, so the error sums ride along and every model-level figure
    is one more aggregate of this frame (no join back to the cells)."""
    zero, nul = F.lit(0).cast("long"), F.lit(None).cast("double")
    # One pass over the cells: each cell yields a "true side" and a
    # "predicted side" struct (a Generate, so the contingency is computed once).
    as_true = F.struct(F.col(T).cast("int").alias("label"), F.col("n").alias("support"),
                       zero.alias("predicted"),
                       F.when(F.col(T) == F.col(P), F.col("n")).otherwise(zero).alias("tp"),
                       F.col("se_raw").alias("se_raw"), F.col("n_raw").alias("n_raw"),
                       F.col("se_pred").alias("se_pred"))
    as_pred = F.struct(F.col(P).cast("int").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                       zero.alias("tp"), nul.alias("se_raw"), zero.alias("n_raw"), nul.alias("se_pred"))
    sides = cm.select(M, F.inline(F.array(as_true, as_pred)))
    g = sides.groupBy(M, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"),
        F.sum("se_raw").alias("se_raw"), F.sum("n_raw").alias("n_raw"), F.sum("se_pred").alias("se_pred"))
    return g.select(M, "label", "support", "predicted", "tp", "se_raw", "n_raw", "se_pred",
                    _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _safe_div(F.col("tp"), F.col("support")).alias("recall"),
                    _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def summary(long: DataFrame, digits: int | None = 4) -> DataFrame:
    """model_name, mse, accuracy, f1_macro, f1_weighted (+ macro P/R), sorted
    by f1_macro desc, rounded to ``digits`` as pandas ``round`` does.

    MSE uses the raw predictions when the model has any, else the discrete
    ones (rows without a raw value are left out of the raw MSE).
    """
    pc = per_class(contingency(long))
    g = pc.groupBy(M).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.sum("se_raw").alias("se_raw"), F.sum("n_raw").alias("n_raw"), F.sum("se_pred").alias("se_pred"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"))
    out = g.select(
        M,
        F.when(F.col("n_raw") > 0, F.col("se_raw") / F.col("n_raw"))
        .otherwise(F.col("se_pred") / F.col("n")).alias("mse"),
        (F.col("correct") / F.col("n")).alias("accuracy"),
        "f1_macro", "f1_weighted", "precision_macro", "recall_macro",
        F.col("n").cast("long").alias("n"), F.col("n_raw").cast("long").alias("n_raw"))
    if digits is not None:
        from ..functions.scores import np_round
        out = out.select(M, *[np_round(c, digits).alias(c) for c in out.columns
                              if c not in (M, "n", "n_raw")], "n", "n_raw")
    return out.orderBy(F.desc("f1_macro"), M)


def _grid(models: DataFrame, labels: list[int]) -> DataFrame:
    seq = F.array(*[F.lit(v) for v in labels])
    return (models.select(M).distinct()
            .withColumn(T, F.explode(seq)).withColumn("pred_label", F.explode(seq)))


def confusion_matrix(long: DataFrame, labels=REPORT_LABELS) -> DataFrame:
    """Fixed-label confusion counts (others dropped, zero cells present)."""
    cm = materialise_small(contingency(long))
    counts = cm.filter(F.col(T).isin(labels) & F.col(P).isin(labels)).select(
        M, T, F.col(P).alias("pred_label"), "n")
    return (_grid(cm, list(labels)).join(counts, [M, T, "pred_label"], "left")
            .select(M, T, "pred_label", F.coalesce("n", F.lit(0)).alias("n")))


def confusion_observed(long: DataFrame) -> DataFrame:
    """Confusion counts over the observed label union of each model."""
    cm = materialise_small(contingency(long))
    labels = per_class(cm).groupBy(M).agg(F.collect_set("label").alias("ls"))  # <= K per model
    grid = (labels.withColumn(T, F.explode("ls")).withColumn("pred_label", F.explode("ls"))
            .drop("ls"))
    counts = cm.select(M, T, F.col(P).alias("pred_label"), "n")
    return (grid.join(counts, [M, T, "pred_label"], "left")
            .select(M, T, "pred_label", F.coalesce("n", F.lit(0)).alias("n")))


def classification_report(long: DataFrame, labels=REPORT_LABELS, names=TARGET_NAMES) -> DataFrame:
    """Per-class precision/recall/f1/support on fixed labels, then
    'accuracy' (or 'micro avg' when other labels occur), 'macro avg' and
    'weighted avg' rows."""
    pc = materialise_small(per_class(contingency(long)))
    name_of = F.element_at(F.create_map(*[x for i, n in zip(labels, names)
                                          for x in (F.lit(i), F.lit(n))]), F.col("label"))
    seq = F.array(*[F.lit(v) for v in labels])
    grid = pc.select(M).distinct().withColumn("label", F.explode(seq))
    fixed = (grid.join(pc.filter(F.col("label").isin(labels)), [M, "label"], "left")
             .fillna(0, ["support", "predicted", "tp"]).fillna(0.0, ["precision", "recall", "f1"]))
    rows = fixed.select(M, name_of.alias("class"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    tot = fixed.groupBy(M).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum("support").alias("s"), F.sum("predicted").alias("pr"), F.sum("tp").alias("tp"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    extra = pc.groupBy(M).agg(F.count_if(~F.col("label").isin(labels)).alias("other"),
                              F.sum("support").alias("n_all"))
    tot = tot.join(extra, M)
    micro_p = _safe_div(F.col("tp"), F.col("pr"))
    micro_r = _safe_div(F.col("tp"), F.col("s"))
    micro_f = _safe_div(2 * micro_p * micro_r, micro_p + micro_r)
    is_acc = F.col("other") == 0
    acc = tot.select(
        M, F.when(is_acc, F.lit("accuracy")).otherwise(F.lit("micro avg")).alias("class"),
        F.when(is_acc, F.lit(None).cast("double")).otherwise(micro_p).alias("precision"),
        F.when(is_acc, F.lit(None).cast("double")).otherwise(micro_r).alias("recall"),
        F.when(is_acc, F.col("tp") / F.col("n_all")).otherwise(micro_f).alias("f1"),
        F.when(is_acc, F.col("n_all")).otherwise(F.col("s")).cast("long").alias("support"))
    macro = tot.select(M, F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("s").cast("long").alias("support"))
    weighted = tot.select(M, F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                          F.col("s").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def rank_in_family(summary_df: DataFrame, include: str, exclude: str | None = None,
                   metric: str = "f1_macro") -> DataFrame:
    """Models whose name contains ``include`` (case-insensitive) and not
    ``exclude``, ranked by ``metric`` desc (name breaks ties)."""
    name = F.lower(F.col(M))
    cond = F.coalesce(name.contains(include.lower()), F.lit(False))
    if exclude:
        cond = cond & ~F.coalesce(name.contains(exclude.lower()), F.lit(False))
    w = Window.orderBy(F.desc(metric), M)  # summary rows: one per model
    return summary_df.filter(cond).withColumn("rank", F.row_number().over(w))


def metrics_long(summary_df: DataFrame, metrics=("mse", "accuracy", "f1_macro", "f1_weighted")) -> DataFrame:
    return summary_df.unpivot([M], list(metrics), "metric", "score")


def regression_eval(preds: DataFrame, pred_col: str, label_col: str, lo: int = 0, hi: int = 4) -> DataFrame:
    """Validation metrics for a regressor: discretise both sides (half-even,
    clip), then macro P/R/F1 and accuracy on the classes, MSE on the reals."""
    from ..functions.scores import discretize
    long = preds.select(F.lit("model").alias(M), discretize(label_col, lo, hi).alias(T),
                        discretize(pred_col, lo, hi).alias(P),
                        F.col(pred_col).cast("double").alias("_p"), F.col(label_col).cast("double").alias("_l"))
    # MSE on the real values rides in the contingency as the "raw" error:
    # squared error of (label - prediction) summed per cell.
    long = long.withColumn(RAW, F.col(T).cast("double") - (F.col("_l") - F.col("_p")))
    s = summary(long.drop("_p", "_l"), digits=None)
    return s.select(F.col("precision_macro").alias("precision"), F.col("recall_macro").alias("recall"),
                    "f1_macro", "accuracy", "mse")

