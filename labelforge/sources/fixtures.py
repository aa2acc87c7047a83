"""Derived views over the driver tables, each written twice in one place:
as a Spark DataFrame builder and as a DuckDB CTE body for the oracle SQL.

All views are deterministic functions of ``documents`` / ``events`` rows, so
their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from .tables import documents, events

LABEL_NAMES = list(S.LABEL_CODES)
PROBLEMATIC_LABEL = S.PROBLEMATIC_LABEL

# --- fixed values -----------------------------------------------------------
EVENT_SCORE = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
MODEL_KEYS = {"fewshot_250": 11, "fewshot_1000": 13, "full_finetune": 17}
NO_RAW_MODEL = "zeroshot"
TEST_LEXICON = ["worthless", "idiot", "license", "licensed"]
PANEL_RATERS = 6
OWN_RATERS = 3
# ---------------------------------------------------------------------------


def _sql_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


#: The label names as a DuckDB list.
LABELS_SQL = "[" + _sql_list(LABEL_NAMES) + "]"


# ---------------------------------------------------------------- Spark side
def with_scores(d: DataFrame) -> DataFrame:
    """The ``v_scored`` derivation; works on batch and streaming frames."""
    raw = ((F.col("doc_id") * 37 + F.col("n_chars")) % 61).cast("double") / 10 - 0.5
    return d.withColumn("raw_score", raw).withColumn("int_score", S.score_to_int("raw_score"))


def v_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(documents(spark, sf_dir))


def v_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).withColumns({
        "language_score": ((F.col("doc_id") * 13) % 100) / 100.0,
        "token_count": (F.col("n_chars") / 4).cast("long"),
        "snapshot": F.col("source"),
    })


def panel_score(j: int):
    return ((F.col("doc_id") * (j + 3) + F.floor(F.col("n_chars") / (j + 1)))
            % 5).cast("int")


def v_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    return d.withColumns({f"s{j}": panel_score(j) for j in range(PANEL_RATERS)})


def v_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    flag = F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("boolean")).otherwise(
        F.col("doc_id") % 11 == 0)
    return d.withColumn("problematic", flag)


def _name_of(c):
    return F.element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), c + 1)


def v_panel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows as the labelling tool stores them: external labels as a
    list-text ``"['None' 'Good' 'Basic']"``, own labels by name, a flag."""
    p = v_panel(spark, sf_dir)
    ext = F.concat(F.lit("['"), F.concat_ws("' '", *[_name_of(F.col(f"s{j}"))
                                                     for j in range(OWN_RATERS, PANEL_RATERS)]),
                   F.lit("']"))
    flag = F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("boolean")).otherwise(
        F.col("doc_id") % 11 == 0)
    return p.select(
        "doc_id", "text",
        ext.alias("educational_value_labels"),
        *[_name_of(F.col(f"s{j}")).alias(f"own_label_{j + 1}") for j in range(OWN_RATERS)],
        flag.alias("problematic_content_label_present"))


def v_panel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as JSON list text; every 17th row malformed, every 13th short."""
    p = v_panel(spark, sf_dir)
    full = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(f"s{j}").cast("string")
                                                    for j in range(PANEL_RATERS)]), F.lit("]"))
    short = F.concat(F.lit("["), F.col("s0").cast("string"), F.lit(", "),
                     F.col("s1").cast("string"), F.lit("]"))
    js = (F.when(F.col("doc_id") % 17 == 0, F.lit("[1, 2"))
          .when(F.col("doc_id") % 13 == 0, short)
          .otherwise(full))
    return p.select("doc_id", js.alias("all_scores"))


def v_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ratings (item_id, rater_id, score) from events: earliest event per
    (item, rater)."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "props")
    score_map = F.create_map(*[x for k, v in EVENT_SCORE.items() for x in (F.lit(k), F.lit(v))])
    e = e.select(
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("user_id").alias("rater_id"),
        F.col("event_id"),
        F.try_element_at(score_map, F.col("event_type")).alias("score"))
    # min_by keeps this a partial/final hash aggregate (no window sort).
    return (e.groupBy("item_id", "rater_id")
            .agg(F.min_by("score", "event_id").alias("score")))


def v_preds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    cols = {"true_label": ((F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int")}
    for m, k in MODEL_KEYS.items():
        raw = (F.col("true_label")
               + ((F.col("doc_id") * k + F.col("n_chars")) % 21 - 10) / 8.0)
        cols[f"raw_prediction_{m}"] = raw
    out = d.withColumns(cols)
    more = {f"predicted_label_{m}": S.discretize(f"raw_prediction_{m}") for m in MODEL_KEYS}
    more[f"predicted_label_{NO_RAW_MODEL}"] = ((F.col("doc_id") * 23 + F.col("n_chars")) % 5).cast("int")
    return out.withColumns(more)


def llm_prediction_col():
    return (F.when(F.col("doc_id") % 19 == 0, F.lit(-1))
            .when(F.col("doc_id") % 29 == 0, F.lit(5))
            .otherwise(((F.col("doc_id") * 3 + F.col("n_chars")) % 5).cast("int")))


def v_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    return d.select("doc_id", "text", llm_prediction_col().alias("gemini_prediction"))


def v_llm_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    i = F.col("doc_id")
    sc = ((i * 3 + F.col("n_chars")) % 6).cast("string")
    resp = (F.when(i % 31 == 0, F.lit(None).cast("string"))
            .when(i % 11 == 0, F.lit("The passage could not be judged."))
            .when(i % 7 == 0, F.concat(F.lit("Reasoning. EDUCATIONAL SCORE: "), sc,
                                       F.lit(" (revised) Educational score: "),
                                       ((i + 1) % 6).cast("string")))
            .when(i % 5 == 0, F.concat(F.lit("educational score:"), sc))
            .otherwise(F.concat(F.lit("Justification: adds points.\nEducational score:  "), sc)))
    return d.select("doc_id", resp.alias("response"))


def v_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).filter(F.col("doc_id") % 3 == 0)


# --------------------------------------------------------------- DuckDB side
_NAMES_SQL = "[" + _sql_list(LABEL_NAMES) + "]"


def _panel_cols() -> str:
    return ", ".join(f"CAST((doc_id*{j + 3} + n_chars // {j + 1}) % 5 AS INTEGER) AS s{j}"
                     for j in range(PANEL_RATERS))


SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_scored": ("""SELECT *, CAST(round_even(greatest(0.0, least(5.0, raw_score)), 0) AS INTEGER) AS int_score
        FROM (SELECT *, CAST((doc_id*37 + n_chars) % 61 AS DOUBLE)/10 - 0.5 AS raw_score FROM documents)""", ()),
    "v_corpus": ("""SELECT *, ((doc_id*13) % 100)/100.0 AS language_score,
        n_chars // 4 AS token_count, source AS snapshot FROM v_scored""", ("v_scored",)),
    "v_panel": (f"SELECT doc_id, text, n_chars, {_panel_cols()} FROM documents", ()),
    "v_flags": ("""SELECT *, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 11 = 0 END AS problematic
        FROM documents""", ()),
    "v_panel_text": (f"""SELECT doc_id, text,
        '[''' || array_to_string([{_NAMES_SQL}[s3+1], {_NAMES_SQL}[s4+1], {_NAMES_SQL}[s5+1]], ''' ''') || ''']'
            AS educational_value_labels,
        {_NAMES_SQL}[s0+1] AS own_label_1, {_NAMES_SQL}[s1+1] AS own_label_2, {_NAMES_SQL}[s2+1] AS own_label_3,
        CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 11 = 0 END AS problematic_content_label_present
        FROM v_panel""", ("v_panel",)),
    "v_panel_json": ("""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '[1, 2'
            WHEN doc_id % 13 = 0 THEN '[' || s0 || ', ' || s1 || ']'
            ELSE '[' || s0 || ', ' || s1 || ', ' || s2 || ', ' || s3 || ', ' || s4 || ', ' || s5 || ']' END
            AS all_scores FROM v_panel""", ("v_panel",)),
    "v_ratings": ("""SELECT item_id, rater_id, arg_min(score, event_id) AS score FROM (
        SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, user_id AS rater_id, event_id,
          CASE event_type """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_SCORE.items())
                  + """ END AS score FROM events) GROUP BY item_id, rater_id""", ()),
    "v_preds_wide": ("SELECT doc_id, text, n_chars, true_label, "
                     + ", ".join(f"raw_prediction_{m}" for m in MODEL_KEYS) + ", "
                     + ", ".join(f"CAST(greatest(0, least(4, round_even(raw_prediction_{m}, 0))) AS INTEGER)"
                                 f" AS predicted_label_{m}" for m in MODEL_KEYS)
                     + f", CAST((doc_id*23 + n_chars) % 5 AS INTEGER) AS predicted_label_{NO_RAW_MODEL} FROM (SELECT *, "
                     + ", ".join(f"true_label + ((doc_id*{k} + n_chars) % 21 - 10)/8.0 AS raw_prediction_{m}"
                                 for m, k in MODEL_KEYS.items())
                     + " FROM (SELECT doc_id, text, n_chars, CAST((doc_id*7 + n_chars) % 5 AS INTEGER)"
                       " AS true_label FROM documents))", ()),
    "v_llm": ("""SELECT doc_id, text, CASE WHEN doc_id % 19 = 0 THEN -1 WHEN doc_id % 29 = 0 THEN 5
        ELSE CAST((doc_id*3 + n_chars) % 5 AS INTEGER) END AS gemini_prediction FROM documents""", ()),
    "v_llm_response": ("""SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN NULL
        WHEN doc_id % 11 = 0 THEN 'The passage could not be judged.'
        WHEN doc_id % 7 = 0 THEN 'Reasoning. EDUCATIONAL SCORE: ' || ((doc_id*3 + n_chars) % 6)
             || ' (revised) Educational score: ' || ((doc_id+1) % 6)
        WHEN doc_id % 5 = 0 THEN 'educational score:' || ((doc_id*3 + n_chars) % 6)
        ELSE 'Justification: adds points.' || chr(10) || 'Educational score:  ' || ((doc_id*3 + n_chars) % 6)
        END AS response FROM documents""", ()),
    "v_annotated": ("SELECT * FROM v_scored WHERE doc_id % 3 = 0", ("v_scored",)),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining ``names`` and their deps."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in SQL_VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][0]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
