"""Score / label scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import agreement as G
from ..sources import fixtures as V
from ..functions.text import WS, sql_ws_chars
from ..sources.tables import documents
from .registry import register

NAMES = V.LABELS_SQL
PROB = V.PROBLEMATIC_LABEL


@register("score_to_int", """SELECT doc_id, raw_score, int_score,
    coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 6 AS INTEGER) END, int_score) AS int_score_filled
    FROM v_scored""", ("v_scored",))
def score_to_int(spark, sf):
    s = V.v_scored(spark, sf)
    given = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise((F.col("doc_id") % 6).cast("int"))
    return s.select("doc_id", "raw_score", "int_score",
                    S.int_score_fallback(given, "raw_score").alias("int_score_filled"))


_PL = [f"predicted_label_{m}" for m in V.MODEL_KEYS]


@register("discretize", f"""SELECT doc_id, {", ".join(_PL)},
    CAST(greatest(0, least(4, round_even(raw_score, 0))) AS INTEGER) AS label_from_score
    FROM v_preds_wide JOIN v_scored USING (doc_id)""", ("v_preds_wide", "v_scored"))
def discretize(spark, sf):
    p = V.v_preds_wide(spark, sf).select("doc_id", *_PL)
    s = V.v_scored(spark, sf).select("doc_id", S.discretize("raw_score").alias("label_from_score"))
    return p.join(s, "doc_id")


@register("label_encode", f"""SELECT doc_id, label, CAST(list_position({NAMES}, label) - 1 AS INTEGER) AS code
    FROM (SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN '{PROB}' ELSE own_label_1 END AS label
          FROM v_panel_text)""", ("v_panel_text",))
def label_encode(spark, sf):
    p = V.v_panel_text(spark, sf)
    lab = F.when(F.col("doc_id") % 37 == 0, F.lit(PROB)).otherwise(F.col("own_label_1"))
    return p.select("doc_id", lab.alias("label")).withColumn("code", S.encode_label("label"))


@register("gold_from_labels", f"""SELECT doc_id, text,
    CAST(round_even(list_avg(list_transform(regexp_extract_all(educational_value_labels, '''(.*?)''', 1),
        lambda x: list_position({NAMES}, x) - 1)), 0) AS INTEGER) AS int_score
    FROM v_panel_text WHERE problematic_content_label_present = FALSE""", ("v_panel_text",))
def gold_from_labels(spark, sf):
    p = V.v_panel_text(spark, sf).filter(F.col("problematic_content_label_present") == F.lit(False))
    codes = S.encode_labels(S.parse_list_text("educational_value_labels"))
    return p.select("doc_id", "text", S.mean_round(codes).alias("int_score"))


@register("gold_panel", f"""SELECT a1.doc_id, CAST(6 AS BIGINT) AS n_labels,
    CAST(round_even((list_position({NAMES}, a1.our_label) + list_position({NAMES}, a2.our_label)
        + list_position({NAMES}, a3.our_label) - 3 + s3 + s4 + s5) / 6.0, 0) AS INTEGER) AS int_score
    FROM (SELECT doc_id, own_label_1 AS our_label FROM v_panel_text) a1
    JOIN (SELECT doc_id, own_label_2 AS our_label FROM v_panel_text) a2 ON a1.doc_id = a2.doc_id
    JOIN (SELECT doc_id, own_label_3 AS our_label FROM v_panel_text) a3 ON a1.doc_id = a3.doc_id
    JOIN v_panel p ON p.doc_id = a1.doc_id""", ("v_panel_text", "v_panel"))
def gold_panel(spark, sf):
    pt = V.v_panel_text(spark, sf)
    raters = [pt.select("doc_id", F.col(f"own_label_{r}").alias("our_label")) for r in (1, 2, 3)]
    ext = pt.select("doc_id", S.parse_list_text("educational_value_labels").alias("labels"))
    return G.gold_from_panel(raters, ext, "doc_id").select(
        "doc_id", F.size("all_labels").cast("long").alias("n_labels"), "int_score")


@register("parse_labels", """SELECT doc_id, CAST(len(l) AS BIGINT) AS n_labels, array_to_string(l, '|') AS labels
    FROM (SELECT doc_id, regexp_extract_all(educational_value_labels, '''(.*?)''', 1) AS l FROM v_panel_text)""",
          ("v_panel_text",))
def parse_labels(spark, sf):
    p = V.v_panel_text(spark, sf).select("doc_id", S.parse_list_text("educational_value_labels").alias("l"))
    return p.select("doc_id", F.size("l").cast("long").alias("n_labels"),
                    F.concat_ws("|", "l").alias("labels"))


@register("parse_llm_score", f"""SELECT doc_id, CASE WHEN response IS NULL OR length(trim(response, {sql_ws_chars()})) = 0
    THEN -1 ELSE coalesce(TRY_CAST(nullif(regexp_extract(response, 'Educational score:[{WS}]*(\\d+)', 1, 'i'), '')
    AS INTEGER), -1) END AS score FROM v_llm_response""", ("v_llm_response",))
def parse_llm_score(spark, sf):
    r = V.v_llm_response(spark, sf)
    return r.select("doc_id", S.parse_llm_score("response").alias("score"))


PROMPT_HEAD = ("Rate how useful the following web text is for teaching at primary to "
               "secondary school level. Add one point for each criterion met: relevant "
               "information; coherent coverage of a topic; suitable for teaching; clear and "
               "substantial educational content; outstanding educational value.\n\nText:\n")
PROMPT_TAIL = "\n\nAnswer with a short justification, then 'Educational score: <points>'."


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("prompt_render", f"""SELECT doc_id, CAST(length(p) AS BIGINT) AS prompt_chars, md5(p) AS prompt_md5
    FROM (SELECT doc_id, {_sql_str(PROMPT_HEAD)} || text || {_sql_str(PROMPT_TAIL)} AS p FROM documents)""")
def prompt_render(spark, sf):
    from ..operators.inference import render_prompt
    d = documents(spark, sf).select("doc_id", render_prompt("text", PROMPT_HEAD, PROMPT_TAIL).alias("p"))
    return d.select("doc_id", F.length("p").cast("long").alias("prompt_chars"), F.md5("p").alias("prompt_md5"))


@register("rescale_scores", "SELECT doc_id, round(int_score * 4 / 5.0, 6) AS target FROM v_scored", ("v_scored",))
def rescale_scores(spark, sf):
    return V.v_scored(spark, sf).select("doc_id", F.round(S.rescale("int_score"), 6).alias("target"))


@register("label_decode", f"""SELECT doc_id, coalesce({NAMES}[gemini_prediction + 1], CAST(gemini_prediction AS VARCHAR))
    AS label FROM v_llm""", ("v_llm",))
def label_decode(spark, sf):
    return V.v_llm(spark, sf).select("doc_id", S.decode_code("gemini_prediction").alias("label"))


_HALVES = "(doc_id % 11) / 2.0"


@register("label_decode_frame", f"""SELECT doc_id, coalesce({NAMES}[gemini_prediction + 1], CAST(gemini_prediction AS VARCHAR)) AS whole,
    CASE WHEN {_HALVES} = floor({_HALVES}) AND {_HALVES} < 5 THEN {NAMES}[CAST({_HALVES} AS INTEGER) + 1]
         ELSE CAST({_HALVES} AS VARCHAR) END AS halves FROM v_llm""", ("v_llm",))
def label_decode_frame(spark, sf):
    """Every numeric column but the id decoded; a value between two codes, or
    beyond them, stays as it is."""
    v = V.v_llm(spark, sf).select("doc_id", F.col("gemini_prediction").alias("whole"),
                                  ((F.col("doc_id") % 11) / F.lit(2.0)).alias("halves"))
    return S.decode_frame(v, exclude=["doc_id"])


@register("annotator_name", """SELECT doc_id, 'Human (' || upper(substr(source, 1, 1)) || lower(substr(source, 2)) || ')'
    AS annotator FROM documents""")
def annotator_name(spark, sf):
    d = documents(spark, sf)
    path = F.concat(F.lit("annotations/annotations_"), F.col("source"), F.lit(".json"))
    return d.select("doc_id", S.human_display_name(path).alias("annotator"))
