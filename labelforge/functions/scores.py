"""Score and label scalar functions as native column expressions.

Python/numpy round half to even; Spark ``round`` rounds half up, so ``rint``
/ ``bround`` are used. NaN under a clamp becomes 0 in Python but 5 in Spark,
so NaN is mapped to 0 before clamping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, col_of, py_strip

# --- fixed values -----------------------------------------------------------
LABEL_CODES = {"None": 0, "Minimal": 1, "Basic": 2, "Good": 3, "Excellent": 4}
PROBLEMATIC_LABEL = "❗ Problematic Content ❗"
LLM_SCORE_PATTERN = r"Educational score:\s*(\d+)"  # searched case-insensitively
LLM_FAILED = -1
LIST_ITEM_PATTERN = r"'(.*?)'"
# ---------------------------------------------------------------------------
# The same pattern for the JVM: Python's \s is Unicode whitespace, Java's is
# ASCII only, so \s becomes the Python whitespace class.
LLM_SCORE_RE = "(?i)" + LLM_SCORE_PATTERN.replace(r"\s", f"[{WS}]")


def score_to_int(c, lo: float = 0.0, hi: float = 5.0) -> Column:
    """Clamp to [lo, hi] then round half-even -> int (NaN -> lo)."""
    x = F.nanvl(col_of(c).cast("double"), F.lit(float(lo)))
    return F.rint(F.greatest(F.lit(float(lo)), F.least(x, F.lit(float(hi))))).cast("int")


def int_score_fallback(int_col, score_col) -> Column:
    """Keep an existing int score, else derive it from the real score."""
    return F.coalesce(col_of(int_col).cast("int"), score_to_int(score_col))


def discretize(c, lo: int = 0, hi: int = 4) -> Column:
    """Round half-even then clip to lo..hi. NaN raises (an undefined class)."""
    x = col_of(c).cast("double")
    x = F.when(F.isnan(x), F.raise_error(F.lit("NaN prediction cannot be discretised"))
               ).otherwise(x)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint(x).cast("int")))


def rescale(c, source_max: float = 5.0, target_max: float = 4.0) -> Column:
    """Real-valued rescale of a 0..source_max score to 0..target_max."""
    return col_of(c).cast("double") * F.lit(float(target_max)) / F.lit(float(source_max))


def label_map(codes: dict[str, int] | None = None) -> Column:
    codes = LABEL_CODES if codes is None else codes
    return F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])


def encode_label(c, codes: dict[str, int] | None = None, strict: bool = False) -> Column:
    """Label name -> ordinal code. Lenient: unknown -> null; strict: error."""
    code = F.try_element_at(label_map(codes), col_of(c))
    if strict:
        code = F.when(col_of(c).isNotNull() & code.isNull(),
                      F.raise_error(F.concat(F.lit("unknown label: "), col_of(c)))
                      ).otherwise(code)
    return code


def encode_labels(arr, codes: dict[str, int] | None = None) -> Column:
    m = label_map(codes)
    return F.transform(col_of(arr), lambda x: F.try_element_at(m, x))


def decode_code(c, codes: dict[str, int] | None = None) -> Column:
    """Code -> label name; values that are no code (2.7 among them) are kept
    as their string form."""
    codes = LABEL_CODES if codes is None else codes
    inv = F.create_map(*[x for k, v in codes.items() for x in (F.lit(v), F.lit(k))])
    x = col_of(c)
    whole = x.try_cast("int")
    return F.coalesce(F.when(whole == x, F.try_element_at(inv, whole)), x.cast("string"))


def decode_frame(df: DataFrame, exclude=(), codes: dict[str, int] | None = None) -> DataFrame:
    """``decode_code`` on every numeric column that is not excluded."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)} - set(exclude)
    return df.select(*[decode_code(c, codes).alias(c) if c in numeric else F.col(c) for c in df.columns])


def mean_round(arr) -> Column:
    """Half-even rounded mean of an int array; empty/null -> null."""
    a = col_of(arr)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(a) > 0, F.rint(s / F.size(a)).cast("int"))


# Python's "." excludes only "\n"; Java's also excludes other line breaks.
LIST_ITEM_RE = LIST_ITEM_PATTERN.replace(".", "[^\n]")


def parse_list_text(c) -> Column:
    """``"['None' 'Good']"`` -> ["None", "Good"]."""
    return F.regexp_extract_all(col_of(c), F.lit(LIST_ITEM_RE), 1)


def parse_llm_score(c) -> Column:
    """First ``Educational score: <int>`` (case-insensitive); miss/blank -> -1."""
    x = col_of(c)
    got = F.nullif(F.regexp_extract(x, LLM_SCORE_RE, 1), F.lit("")).try_cast("int")
    blank = x.isNull() | (F.length(py_strip(x)) == 0)
    return F.when(blank, F.lit(LLM_FAILED)).otherwise(F.coalesce(got, F.lit(LLM_FAILED)))


def is_blank(c) -> Column:
    """Null or only whitespace (``not text or not text.strip()``)."""
    return col_of(c).isNull() | (F.length(py_strip(c)) == 0)


def human_display_name(path_col) -> Column:
    """``…/annotations_jordan.json`` -> ``Human (Jordan)``."""
    base = F.regexp_extract(col_of(path_col), r"([^/]+)$", 1)
    last = F.element_at(F.split(base, "_"), -1)
    stem = F.split(last, r"\.").getItem(0)
    cap = F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(F.substring(stem, 2, 1 << 30)))
    return F.concat(F.lit("Human ("), cap, F.lit(")"))


def np_round(c, digits: int) -> Column:
    """numpy/pandas ``round(x, digits)``: ``rint(x * 10**d) / 10**d`` in
    binary floating point (half-even on the scaled value)."""
    f = float(10 ** digits)
    return F.rint(col_of(c).cast("double") * F.lit(f)) / F.lit(f)


def py_format_round(c, digits: int) -> Column:
    """``float(f"{x:.{digits}f}")``: Java's DecimalFormat (behind
    ``format_number``) rounds the exact binary value half-even, as Python's
    formatting does; ``round``/``bround`` round the shortest decimal string."""
    s = F.regexp_replace(F.format_number(col_of(c).cast("double"), digits), ",", "")
    return s.cast("double")


def json_list(c) -> Column:
    """JSON list text -> array<string>; malformed / non-list -> empty array."""
    return F.coalesce(F.from_json(col_of(c), "array<string>"), F.array().cast("array<string>"))
