"""Model / annotator evaluation queries.

The evaluation table ("master") is the long union of every model's
predictions (from the wide prediction table) and of the annotators' labels
left-joined to the gold rows, with null predictions dropped. Annotations are
keyed by the document id, so a text that occurs many times (a hot group of
copies) joins one-to-one instead of emitting every pair of copies;
``joins.text_join`` covers sources that only share the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import joins as J
from ..operators import metrics as MT
from ..operators import reshape as X
from ..operators import sampling as R
from ..operators.common import stored
from ..sources import fixtures as V
from .registry import register

LLM_NAME = "llm_rubric"
HUMAN_PATH = "annotations/annotations_panel.json"
HUMAN_NAME = "Human (Panel)"
NAMES = V.LABELS_SQL
MODELS = list(V.MODEL_KEYS) + [V.NO_RAW_MODEL]
VIEWS = ("v_preds_wide", "v_llm", "v_panel_text")


def human_labels(spark, sf):
    p = V.v_panel_text(spark, sf)
    lab = F.when(F.col("doc_id") % 37 == 0, F.lit(V.PROBLEMATIC_LABEL)).otherwise(F.col("own_label_1"))
    return p.select("doc_id", "text", lab.alias("our_label"))


def master(spark, sf):
    """One row per (gold row, model or annotator). Annotator labels are
    left-joined onto the wide prediction rows by id, then one ``inline``
    emits every model and annotator for the row in a single pass."""
    wide = V.v_preds_wide(spark, sf)
    llm = V.v_llm(spark, sf).select("doc_id", F.col("gemini_prediction").alias("_p_llm"))
    human = human_labels(spark, sf).select("doc_id", S.encode_label("our_label").alias("_p_human"))
    rows = wide.join(llm, "doc_id", "left").join(human, "doc_id", "left")
    # the annotator's display name comes from its file name, "Human (Panel)"
    human_name = S.human_display_name(F.lit(HUMAN_PATH))
    no_raw = F.lit(None).cast("double")
    structs = []
    for m in X.model_names(wide):
        raw = F.col(X.RAW_PREFIX + m) if X.RAW_PREFIX + m in wide.columns else no_raw
        structs.append(F.struct(F.lit(m).alias("model_name"),
                                F.col(X.PRED_PREFIX + m).cast("int").alias("final_prediction"),
                                raw.cast("double").alias("raw_prediction")))
    for name, col in ((F.lit(LLM_NAME), "_p_llm"), (human_name, "_p_human")):
        structs.append(F.struct(name.alias("model_name"), F.col(col).cast("int").alias("final_prediction"),
                                no_raw.alias("raw_prediction")))
    return (rows.select("true_label", F.inline(F.array(*structs)))
            .dropna(subset=["final_prediction"])
            .select("model_name", "true_label", "final_prediction", "raw_prediction"))


def _long_sql():
    sel = []
    for m in MODELS:
        raw = f"raw_prediction_{m}" if m in V.MODEL_KEYS else "CAST(NULL AS DOUBLE)"
        sel.append(f"SELECT doc_id, text, true_label, '{m}' AS model_name, "
                   f"predicted_label_{m} AS final_prediction, {raw} AS raw_prediction FROM v_preds_wide")
    return " UNION ALL ".join(sel)


MASTER_SQL = f"""models_long AS ({_long_sql()}),
  gold AS (SELECT doc_id, true_label FROM v_preds_wide),
  ann AS (
    SELECT g.true_label, '{LLM_NAME}' AS model_name, l.gemini_prediction AS final_prediction
      FROM gold g LEFT JOIN v_llm l ON g.doc_id = l.doc_id
    UNION ALL
    SELECT g.true_label, '{HUMAN_NAME}', list_position({NAMES}, h.our_label) - 1
      FROM gold g LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN '{V.PROBLEMATIC_LABEL}'
                                  ELSE own_label_1 END AS our_label FROM v_panel_text) h ON g.doc_id = h.doc_id),
  master AS (
    SELECT model_name, true_label, CAST(final_prediction AS INTEGER) AS final_prediction, raw_prediction
      FROM models_long
    UNION ALL
    SELECT model_name, true_label, CAST(final_prediction AS INTEGER), CAST(NULL AS DOUBLE) FROM ann
      WHERE final_prediction IS NOT NULL),
  cm AS (SELECT model_name, true_label AS t, final_prediction AS p, count(*) AS n,
           sum(power(true_label - raw_prediction, 2)) AS se_raw, count(raw_prediction) AS n_raw,
           sum(power(true_label - final_prediction, 2)) AS se_pred FROM master GROUP BY ALL),
  pc AS (SELECT model_name, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
           SELECT model_name, t AS label, n AS support, 0 AS predicted, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM cm
           UNION ALL SELECT model_name, p, 0, n, 0 FROM cm) GROUP BY ALL),
  pcm AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
           coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM pc),
  summ AS (SELECT b.model_name, CASE WHEN n_raw > 0 THEN se_raw / n_raw ELSE se_pred / n END AS mse,
           correct / n AS accuracy, f1_macro, f1_weighted, precision_macro, recall_macro
           FROM (SELECT model_name, sum(n) AS n, sum(CASE WHEN t = p THEN n ELSE 0 END) AS correct,
                   sum(se_raw) AS se_raw, sum(n_raw) AS n_raw, sum(se_pred) AS se_pred FROM cm GROUP BY ALL) b
           JOIN (SELECT model_name, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
                   avg(precision) AS precision_macro, avg(recall) AS recall_macro FROM pcm GROUP BY ALL) f
           USING (model_name)),
  summ4 AS (SELECT model_name, {", ".join(f"round_even({c} * 10000.0, 0) / 10000.0 AS {c}" for c in
           ("mse", "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"))} FROM summ)"""


def _with(sql):
    return f"WITH {MASTER_SQL}\n{sql}"


@register("wide_to_long", "WITH " + f"models_long AS ({_long_sql()}) SELECT * FROM models_long", ("v_preds_wide",))
def wide_to_long(spark, sf):
    return X.wide_to_long(V.v_preds_wide(spark, sf), ["doc_id", "text", "true_label"])


@register("annotator_long", _with("SELECT model_name, true_label, final_prediction FROM master "
                                  f"WHERE model_name IN ('{LLM_NAME}', '{HUMAN_NAME}')"), VIEWS)
def annotator_long(spark, sf):
    m = master(spark, sf)
    return m.filter(F.col("model_name").isin(LLM_NAME, HUMAN_NAME)).select(
        "model_name", "true_label", "final_prediction")


@register("model_summary", _with("SELECT model_name, mse, accuracy, f1_macro, f1_weighted FROM summ4"), VIEWS)
def model_summary(spark, sf):
    return MT.summary(master(spark, sf)).select("model_name", "mse", "accuracy", "f1_macro", "f1_weighted")


@register("macro_pr", _with("""SELECT model_name, round(precision_macro, 6) AS precision_macro,
    round(recall_macro, 6) AS recall_macro FROM summ"""), VIEWS)
def macro_pr(spark, sf):
    s = MT.summary(master(spark, sf), digits=None)
    return s.select("model_name", F.round("precision_macro", 6).alias("precision_macro"),
                    F.round("recall_macro", 6).alias("recall_macro"))


@register("confusion_matrix", _with("""SELECT m.model_name, CAST(t.v AS INTEGER) AS true_label,
    CAST(p.v AS INTEGER) AS pred_label, coalesce(cm.n, 0) AS n
    FROM (SELECT DISTINCT model_name FROM cm) m, range(5) t(v), range(5) p(v)
    LEFT JOIN cm ON cm.model_name = m.model_name AND cm.t = t.v AND cm.p = p.v"""), VIEWS)
def confusion_matrix(spark, sf):
    return MT.confusion_matrix(master(spark, sf))


@register("confusion_observed", _with("""SELECT a.model_name, a.label AS true_label, b.label AS pred_label,
    coalesce(cm.n, 0) AS n FROM pc a JOIN pc b ON a.model_name = b.model_name
    LEFT JOIN cm ON cm.model_name = a.model_name AND cm.t = a.label AND cm.p = b.label"""), VIEWS)
def confusion_observed(spark, sf):
    return MT.confusion_observed(master(spark, sf))


@register("classification_report", _with(f"""
  , fx AS (SELECT m.model_name, CAST(l.v AS INTEGER) AS label, coalesce(support, 0) AS support,
      coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp, coalesce(precision, 0) AS precision,
      coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1
      FROM (SELECT DISTINCT model_name FROM pcm) m CROSS JOIN range(5) l(v)
      LEFT JOIN pcm ON pcm.model_name = m.model_name AND pcm.label = l.v),
  tot AS (SELECT model_name, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(support) AS s,
      sum(predicted) AS pr, sum(tp) AS tp, sum(precision * support) / sum(support) AS wp,
      sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM fx GROUP BY ALL),
  ex AS (SELECT model_name, count(*) FILTER (WHERE label NOT BETWEEN 0 AND 4) AS other, sum(support) AS n_all
      FROM pc GROUP BY ALL),
  t2 AS (SELECT *, coalesce(tp / nullif(pr, 0), 0) AS mip, coalesce(tp / nullif(s, 0), 0) AS mir FROM tot JOIN ex USING (model_name))
  SELECT model_name, {NAMES}[label + 1] AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM fx
  UNION ALL SELECT model_name, CASE WHEN other = 0 THEN 'accuracy' ELSE 'micro avg' END,
    CASE WHEN other = 0 THEN NULL ELSE round(mip, 6) END, CASE WHEN other = 0 THEN NULL ELSE round(mir, 6) END,
    round(CASE WHEN other = 0 THEN tp / n_all ELSE coalesce(2 * mip * mir / nullif(mip + mir, 0), 0) END, 6),
    CAST(CASE WHEN other = 0 THEN n_all ELSE s END AS BIGINT) FROM t2
  UNION ALL SELECT model_name, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(s AS BIGINT) FROM t2
  UNION ALL SELECT model_name, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(s AS BIGINT) FROM t2""".replace(
    "\n  , fx AS", ", fx AS", 1)), VIEWS)
def classification_report(spark, sf):
    r = MT.classification_report(master(spark, sf))
    return r.select("model_name", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


@register("rank_models", _with("""
  , fam AS (SELECT model_name, f1_macro FROM summ4 WHERE coalesce(contains(lower(model_name), 'fewshot'), FALSE)
      AND NOT coalesce(contains(lower(model_name), 'zero'), FALSE)),
  rk AS (SELECT model_name, row_number() OVER (ORDER BY f1_macro DESC, model_name) AS r FROM fam)
  SELECT 'best_fewshot' AS role, coalesce((SELECT model_name FROM rk WHERE r = 1), 'N/A') AS model_name
  UNION ALL SELECT 'second_fewshot', coalesce((SELECT model_name FROM rk WHERE r = 2), 'N/A')
  UNION ALL SELECT 'zero_shot', coalesce((SELECT min(model_name) FROM summ4 WHERE contains(lower(model_name), 'zero')), 'N/A')
  UNION ALL SELECT 'full_finetune', coalesce((SELECT min(model_name) FROM summ4
      WHERE contains(lower(model_name), 'full') AND contains(lower(model_name), 'finetune')), 'N/A')""".replace(
    "\n  , fam AS", ", fam AS", 1)), VIEWS)
def rank_models(spark, sf):
    s = MT.materialise_small(MT.summary(master(spark, sf)))
    fam = MT.rank_in_family(s, "fewshot", "zero")
    roles = spark.createDataFrame([("best_fewshot", 1), ("second_fewshot", 2)], "role string, rank int")
    ranked = roles.join(F.broadcast(fam.select("rank", "model_name")), "rank", "left").select(
        "role", F.coalesce("model_name", F.lit("N/A")).alias("model_name"))
    name = F.lower(F.col("model_name"))
    firsts = s.agg(
        F.min(F.when(name.contains("zero"), F.col("model_name"))).alias("zero_shot"),
        F.min(F.when(name.contains("full") & name.contains("finetune"), F.col("model_name"))).alias("full_finetune"))
    firsts = firsts.unpivot([], ["zero_shot", "full_finetune"], "role", "model_name").select(
        "role", F.coalesce("model_name", F.lit("N/A")).alias("model_name"))
    return ranked.unionByName(firsts)


@register("metrics_long", _with("""SELECT model_name, metric, score FROM (UNPIVOT (SELECT model_name, mse, accuracy,
    f1_macro, f1_weighted FROM summ4) ON mse, accuracy, f1_macro, f1_weighted INTO NAME metric VALUE score)"""), VIEWS)
def metrics_long(spark, sf):
    return MT.metrics_long(MT.summary(master(spark, sf)))


@register("prediction_distribution", _with("""SELECT model_name, CAST(score AS INTEGER) AS score, count(*) AS n FROM (
    SELECT model_name, final_prediction AS score FROM master
    UNION ALL SELECT 'True Distribution', true_label FROM v_preds_wide) GROUP BY ALL"""), VIEWS)
def prediction_distribution(spark, sf):
    preds = master(spark, sf).select("model_name", F.col("final_prediction").alias("score"))
    truth = V.v_preds_wide(spark, sf).select(F.lit("True Distribution").alias("model_name"),
                                             F.col("true_label").alias("score"))
    return (preds.unionByName(truth).groupBy("model_name", F.col("score").cast("int").alias("score"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("long_to_wide", f"""SELECT doc_id, {", ".join(
    f"max(CASE WHEN model_name = '{m}' THEN final_prediction END) AS {m}" for m in MODELS)}
    FROM ({_long_sql()}) GROUP BY doc_id""", ("v_preds_wide",))
def long_to_wide(spark, sf):
    long = X.wide_to_long(V.v_preds_wide(spark, sf), ["doc_id"])
    return X.long_to_wide(long, "doc_id", MODELS)


RENAME = {"anno_0": "own_anno_1", "anno_1": "own_anno_2", "anno_2": "own_anno_3",
          "anno_3": "anno_1", "anno_4": "anno_2", "anno_5": "anno_3"}


def _expand_sql(src="v_panel_json"):
    cols = ", ".join(f"TRY_CAST(l[{i + 1}] AS DOUBLE) AS {RENAME[f'anno_{i}']}" for i in range(6))
    return (f"SELECT doc_id AS id, {cols} FROM (SELECT doc_id, coalesce(try(from_json(all_scores, '[\"VARCHAR\"]')), "
            f"[]) AS l FROM {src})")


@register("expand_scores", _expand_sql(), ("v_panel_json",))
def expand_scores(spark, sf):
    j = V.v_panel_json(spark, sf).withColumnRenamed("doc_id", "id")
    return X.expand_list(j, "all_scores", "anno", rename=RENAME)


def merged_predictions(spark, sf):
    """Outer-merge the prediction table with the LLM scores on their common
    columns (id, text: one-to-one, null keys match null keys), drop label /
    int_score columns, attach the expanded panel scores by id."""
    wide = V.v_preds_wide(spark, sf)
    df1 = wide.select(F.col("doc_id").alias("id"), "text", F.col("true_label").alias("int_score"),
                      F.col("true_label").alias("real_label"),
                      *[c for c in wide.columns if c.startswith(("predicted_label_", "raw_prediction_"))])
    df2 = V.v_llm(spark, sf).select(F.col("doc_id").alias("id"), "text",
                                    F.col("gemini_prediction").alias("int_score"))
    df2 = df2.withColumnRenamed("int_score", "llm_score")
    merged = J.natural_outer_merge([df1, df2]).drop("real_label")
    merged = J.drop_matching(J.drop_matching(merged, "label"), "int_score")
    scores = X.expand_list(V.v_panel_json(spark, sf).withColumnRenamed("doc_id", "id"),
                           "all_scores", "anno", rename=RENAME)
    return merged.join(scores, "id", "left")


@register("merge_predictions", f"""WITH e AS ({_expand_sql()}),
    m AS (SELECT coalesce(a.id, b.doc_id) AS id, coalesce(a.text, b.text) AS text, {", ".join(f"a.raw_prediction_{m}" for m in V.MODEL_KEYS)},
          b.gemini_prediction AS llm_score
          FROM (SELECT doc_id AS id, * FROM v_preds_wide) a FULL JOIN v_llm b ON a.id IS NOT DISTINCT FROM b.doc_id AND a.text IS NOT DISTINCT FROM b.text)
    SELECT m.*, {", ".join(RENAME.values())} FROM m LEFT JOIN e USING (id)""", ("v_preds_wide", "v_llm", "v_panel_json"))
def merge_predictions(spark, sf):
    return merged_predictions(spark, sf)


@register("column_averages", f"""WITH e AS ({_expand_sql()}),
    m AS (SELECT coalesce(a.id, b.doc_id) AS id, {", ".join(f"a.raw_prediction_{m}" for m in V.MODEL_KEYS)}, b.gemini_prediction AS llm_score
          FROM (SELECT doc_id AS id, * FROM v_preds_wide) a FULL JOIN v_llm b
          ON a.id IS NOT DISTINCT FROM b.doc_id AND a.text IS NOT DISTINCT FROM b.text),
    j AS (SELECT m.*, {", ".join(RENAME.values())} FROM m LEFT JOIN e USING (id))
    SELECT "column", round(mean, 6) AS mean FROM (UNPIVOT (SELECT {", ".join(
        f"avg({c}) AS {c}" for c in [f"raw_prediction_{m}" for m in V.MODEL_KEYS] + ["llm_score"] + list(RENAME.values()))}
        FROM j) ON COLUMNS(*) INTO NAME "column" VALUE mean)""", ("v_preds_wide", "v_llm", "v_panel_json"))
def column_averages(spark, sf):
    a = X.column_averages(merged_predictions(spark, sf), exclude=["id", "text"])
    return a.select("column", F.round("mean", 6).alias("mean"))


@register("score_histogram", """WITH mm AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM v_scored),
    i0 AS (SELECT raw_score AS x, lo, hi, (hi - lo) / 30 AS step,
             CAST(floor((raw_score - lo) * (30 / (hi - lo))) AS INTEGER) AS b0 FROM v_scored, mm),
    i1 AS (SELECT *, CASE WHEN b0 = 30 THEN 29 ELSE b0 END AS b1 FROM i0),
    i2 AS (SELECT *, CASE WHEN x < (CASE WHEN b1 = 30 THEN hi ELSE b1 * step + lo END) THEN b1 - 1 ELSE b1 END AS b2 FROM i1),
    i3 AS (SELECT CASE WHEN x >= (CASE WHEN b2 + 1 = 30 THEN hi ELSE (b2 + 1) * step + lo END) AND b2 <> 29
             THEN b2 + 1 ELSE b2 END AS bin FROM i2)
    SELECT CAST(r.v AS INTEGER) AS bin, round(r.v * ((hi - lo) / 30) + lo, 6) AS bin_lo,
      round(CASE WHEN r.v = 29 THEN hi ELSE (r.v + 1) * ((hi - lo) / 30) + lo END, 6) AS bin_hi, coalesce(c.n, 0) AS n
    FROM range(30) r(v) CROSS JOIN mm LEFT JOIN (SELECT bin, count(*) AS n FROM i3 GROUP BY bin) c ON c.bin = r.v""",
          ("v_scored",))
def score_histogram(spark, sf):
    h = X.histogram(V.v_scored(spark, sf), "raw_score", 30)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n")


@register("class_weights", """WITH lab AS (SELECT doc_id, CAST(greatest(0, least(4, round_even(raw_score, 0))) AS INTEGER) AS label
      FROM v_scored),
    sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
      count(*) OVER (PARTITION BY label) AS n FROM lab),
    tr AS (SELECT label FROM sp WHERE r <= floor(0.8 * n)),
    c AS (SELECT label, count(*) AS n FROM tr GROUP BY label)
    SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
          ("v_scored",))
def class_weights(spark, sf):
    from ..operators.ml import class_weights as cw
    s = V.v_scored(spark, sf).select("doc_id", S.discretize("raw_score").alias("label"))
    train = R.train_val_split(s, 0.2, "doc_id", 42, stratify_col="label").filter(F.col("split") == "train")
    w = cw(train, "label")
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


@register("regression_eval", """WITH p AS (SELECT true_label AS l, raw_prediction_full_finetune AS r,
      CAST(greatest(0, least(4, round_even(raw_prediction_full_finetune, 0))) AS INTEGER) AS pc,
      CAST(greatest(0, least(4, round_even(true_label, 0))) AS INTEGER) AS lc FROM v_preds_wide),
    pc0 AS (SELECT lc AS label, 1 AS support, 0 AS predicted, CASE WHEN lc = pc THEN 1 ELSE 0 END AS tp FROM p
      UNION ALL SELECT pc, 0, 1, 0 FROM p),
    k AS (SELECT label, sum(support) AS s, sum(predicted) AS pr, sum(tp) AS tp FROM pc0 GROUP BY label)
    SELECT round(avg(coalesce(tp / nullif(pr, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(s, 0), 0)), 6) AS recall,
      round(avg(coalesce(2 * tp / nullif(s + pr, 0), 0)), 6) AS f1_macro,
      round((SELECT avg(CASE WHEN lc = pc THEN 1.0 ELSE 0.0 END) FROM p), 6) AS accuracy,
      round((SELECT avg(power(l - r, 2)) FROM p), 6) AS mse FROM k""", ("v_preds_wide",))
def regression_eval(spark, sf):
    w = V.v_preds_wide(spark, sf)
    r = MT.regression_eval(w, "raw_prediction_full_finetune", "true_label")
    return r.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_macro", "accuracy", "mse")])


@register("annotator_by_text", f"""SELECT g.doc_id, g.true_label,
    list_position({NAMES}, h.our_label) - 1 AS final_prediction
    FROM (SELECT doc_id, text, true_label FROM v_preds_wide) g
    LEFT JOIN (SELECT text, arg_min(CASE WHEN doc_id % 37 = 0 THEN '{V.PROBLEMATIC_LABEL}' ELSE own_label_1 END,
                                    doc_id) AS our_label
               FROM v_panel_text GROUP BY text) h ON g.text = h.text""", VIEWS)
def annotator_by_text(spark, sf):
    """Gold rows left-joined to a text-keyed annotation file. The labelling
    tool annotates each distinct text once (earliest copy), so the right
    side is unique per text and repeated gold texts each get that label."""
    ann = (human_labels(spark, sf).groupBy("text")
           .agg(F.min_by("our_label", "doc_id").alias("our_label")))
    gold = V.v_preds_wide(spark, sf).select("doc_id", "text", "true_label")
    return J.text_join(gold, ann, "text", "left").select(
        "doc_id", "true_label", S.encode_label("our_label").alias("final_prediction"))


@register("annotations_fan_out", """SELECT g.doc_id, count(a.doc_id) AS n_annotations
    FROM documents g LEFT JOIN v_annotated a ON g.text = a.text GROUP BY g.doc_id""", ("v_annotated",))
def annotations_fan_out(spark, sf):
    """Left join by text with duplicates on both sides: every copy of a text
    meets every annotation of it, as an SQL join does."""
    from ..sources.tables import documents
    a = V.v_annotated(spark, sf).select("text", F.col("doc_id").alias("annotated_id"))
    j = J.text_join(documents(spark, sf).select("doc_id", "text"), a, "text", "left")
    return j.groupBy("doc_id").agg(F.count("annotated_id").alias("n_annotations"))


@register("annotations_hot_text", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'one hot text' ELSE text END AS text FROM documents)
    SELECT a.doc_id, count(b.doc_id) AS n_annotations, min(b.doc_id) AS first_annotated, CAST(sum(b.doc_id) AS BIGINT) AS checksum
    FROM d a LEFT JOIN (SELECT * FROM d WHERE doc_id % 2 = 0) b ON a.text = b.text GROUP BY a.doc_id""")
def annotations_hot_text(spark, sf):
    """Left join by text where one text holds a third of both sides. All that is
    asked of the annotations of a text adds up, so they are summed by text ahead
    of the join: the pairs of the hot text's rows grow with their square."""
    from ..sources.tables import documents
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("one hot text")).otherwise(F.col("text"))
    d = documents(spark, sf).select("doc_id", text.alias("text")).withColumn("text", J.digest("text"))
    annotated = d.where(F.col("doc_id") % 2 == 0).select("text", F.col("doc_id").alias("annotated_id"))
    by_text = stored(annotated.groupBy("text").agg(
        F.count("annotated_id").alias("n"), F.min("annotated_id").alias("first"), F.sum("annotated_id").alias("total")),
        "annotations-by-text")
    j = J.text_join_split(d, by_text, "text", "left", hot_rows=2000)
    return j.groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_annotations"),
                                   F.min("first").alias("first_annotated"),
                                   F.sum("total").alias("checksum"))


_SAME = "a.id IS NOT DISTINCT FROM b.id AND a.lang IS NOT DISTINCT FROM b.lang"


@register("merge_four_frames", f"""WITH d AS (SELECT *, CASE WHEN doc_id % 500 <> 0 THEN doc_id END AS id FROM documents),
    x AS (SELECT id, lang, n_chars FROM d WHERE doc_id % 2 = 0), y AS (SELECT id, lang, source FROM d WHERE doc_id % 3 = 0),
    z AS (SELECT id, lang, unnest([1, 2]) AS copy FROM d WHERE doc_id % 5 = 0),
    w AS (SELECT id, lang, length(text) AS chars FROM d WHERE doc_id % 7 = 0),
    xy AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.lang, b.lang) AS lang, n_chars, source FROM x a FULL JOIN y b ON {_SAME}),
    xyz AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.lang, b.lang) AS lang, n_chars, source, copy FROM xy a FULL JOIN z b ON {_SAME})
    SELECT coalesce(a.id, b.id) AS id, coalesce(a.lang, b.lang) AS lang, n_chars, source, copy, chars FROM xyz a FULL JOIN w b ON {_SAME}""")
def merge_four_frames(spark, sf):
    """Outer merge of four frames with repeated and null keys, in one shuffle."""
    from ..sources.tables import documents
    d = documents(spark, sf).withColumn("id", F.when(F.col("doc_id") % 500 != 0, F.col("doc_id")))
    part = lambda n, *cols: d.where(F.col("doc_id") % n == 0).select("id", "lang", *cols)
    return J.outer_merge_once([part(2, "n_chars"), part(3, "source"),
                               part(5, F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")),
                               part(7, F.char_length("text").cast("long").alias("chars"))])
