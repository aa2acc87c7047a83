"""Inter-annotator agreement over a long ratings table
``(item, rater, score[, group])``.

Every statistic is algebraic over per-(item, score) counts, so the only
data-sized work is one partial/final hash aggregate on the item key; the
rest runs on frames of at most items x K rows (K = number of classes) or
K x K rows. Items x raters pairs are never formed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


# ------------------------------------------------------------------ shaping
def wide_to_ratings(df: DataFrame, item_col: str, score_cols: list[str],
                    groups: dict[str, str] | None = None) -> DataFrame:
    """Wide per-item score columns -> long ``(item, rater, score[, group])``."""
    out = df.unpivot([item_col], score_cols, "rater", "score").withColumnRenamed(item_col, "item")
    if groups:
        gm = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn("group", F.element_at(gm, F.col("rater")))
    return out.filter(F.col("score").isNotNull())


def gold_from_panel(raters: list[DataFrame], external: DataFrame, id_col: str,
                    problematic: str = "drop") -> DataFrame:
    """Own raters' labels (one frame per rater: ``id, our_label``) inner-joined
    on ``id`` with the external label list; ``all_labels`` = own labels then
    external ones; ``int_score`` = half-even mean of the codes.

    ``problematic='drop'`` leaves the problematic label out of the codes,
    ``'zero'`` counts it as 0.
    """
    joined = reduce(lambda a, b: a.join(b, id_col),
                    [r.select(id_col, F.col("our_label").alias(f"_r{i}"))
                     for i, r in enumerate(raters)])
    joined = joined.join(external.select(id_col, "labels"), id_col)
    labels = F.concat(F.array(*[F.col(f"_r{i}") for i in range(len(raters))]), F.col("labels"))
    codes = dict(S.LABEL_CODES)
    if problematic == "zero":
        codes[S.PROBLEMATIC_LABEL] = 0
    scores = F.filter(S.encode_labels(labels, codes), lambda x: x.isNotNull())
    return joined.select(id_col, labels.alias("all_labels"), scores.alias("all_scores"),
                         S.mean_round(scores).alias("int_score"))


def _keys(by) -> list[str]:
    return list(by or [])


def _with_group(ratings: DataFrame, by):
    """Statistics are computed per group; an ungrouped call uses one
    constant group so that every step stays an aggregate on the keys."""
    if by:
        return ratings, list(by), []
    return ratings.withColumn("_all", F.lit(0)), ["_all"], ["_all"]


# ----------------------------------------------------------------- per item
def item_counts(ratings: DataFrame, by=None) -> DataFrame:
    """``(by..., item, score, n)`` — the one data-sized aggregate. A missing
    rating (null score) is no rating."""
    rated = ratings.filter(F.col("score").isNotNull())
    return rated.groupBy(*_keys(by), "item", "score").agg(F.count(F.lit(1)).alias("n"))


def item_msd(ratings: DataFrame, by=None) -> DataFrame:
    """Mean pairwise squared difference per item (items with >= 2 ratings).

    Closed form ``2 (c * sum x^2 - (sum x)^2) / (c (c - 1))`` replaces the
    O(c^2) pair loop.
    """
    x = F.col("score").cast("double")
    g = ratings.groupBy(*_keys(by), "item").agg(
        F.count("score").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    return g.filter(F.col("c") >= 2).select(
        *_keys(by), "item", "c",
        (2.0 * (F.col("c") * F.col("ss") - F.col("s") * F.col("s"))
         / (F.col("c") * (F.col("c") - 1))).alias("msd"))


def msd(ratings: DataFrame, by=None) -> DataFrame:
    return item_msd(ratings, by).groupBy(*_keys(by)).agg(F.avg("msd").alias("msd"))


def _entropy(c: Column, m: Column) -> tuple[Column, Column]:
    """Shannon entropy (bits) of the (value, n) list ``c`` with sum ``m``, and
    entropy / log2(#distinct)."""
    h = F.aggregate(c, F.lit(0.0), lambda acc, x: acc - (x["n"] / m) * F.log2(x["n"] / m))
    return h, F.when(F.size(c) > 1, h / F.log2(F.size(c))).otherwise(F.lit(0.0))


def item_entropy(ratings: DataFrame, by=None) -> DataFrame:
    """Shannon entropy (bits) per item and entropy / log2(#distinct)."""
    h, norm = _entropy(F.col("c"), F.col("m"))
    return per_item_counts(ratings, _keys(by)).select(
        *_keys(by), "item", h.alias("entropy"), norm.alias("norm_entropy"))


def mean_entropy(ratings: DataFrame, by=None) -> DataFrame:
    return item_entropy(ratings, by).groupBy(*_keys(by)).agg(
        F.avg("entropy").alias("entropy"), F.avg("norm_entropy").alias("norm_entropy"))


# ------------------------------------------------------- Krippendorff alpha
LEVELS = ("nominal", "ordinal", "interval")


def per_item_counts(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., item, c, m)``: ``c`` lists the item's (value, count) pairs
    (at most K entries, however many raters a hot item has: the counts are
    pre-aggregated per (item, value) with a map-side combine first), ``m`` is
    the item's number of ratings."""
    u = item_counts(ratings, keys)
    return u.groupBy(*keys, "item").agg(
        F.collect_list(F.struct(F.col("score").alias("v"), F.col("n").alias("n"))).alias("c"),
        F.sum("n").alias("m"))


def krippendorff_alpha(ratings: DataFrame, level: str = "ordinal", by=None) -> DataFrame:
    """Krippendorff's alpha (nominal / ordinal / interval), missing ratings
    allowed; units with fewer than two ratings are not pairable and dropped.

    alpha = 1 - (N - 1) * sum_ck o_ck d2_ck / sum_ck n_c n_k d2_ck, with the
    coincidences o_ck = sum_u n_uc (n_uk - [c=k]) / (m_u - 1). Each item's
    <= K value counts are paired in place (<= K^2 rows per item): no join.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    ratings, keys, extra = _with_group(ratings, by)
    s = statistics_from_counts(per_item_counts(ratings, keys), keys)
    return s.where(F.col("pairable") > 0).select(*keys, F.col(f"alpha_{level}").alias("alpha")).drop(*extra)


def statistics_from_counts(pi: DataFrame, keys: list[str]) -> DataFrame:
    """msd, entropy, norm_entropy and the three alphas per group, in one pass
    over the per-item (value, count) lists ``(keys, item, c, m)``.

    Every item gives one row for its own figures (a, b null) and at most K^2
    rows for the coincidences; one aggregate sums both kinds. What is left, at
    most K^2 + 1 rows of a group, is gathered into one list per group, and the
    alphas are array expressions over it: one lazy plan, no join.
    """
    h, norm = _entropy(F.col("c"), F.col("m"))
    m = F.col("m")
    s1 = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"] * x["v"])
    s2 = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"] * x["v"] * x["v"])
    spread = F.when(m >= 2, 2.0 * (m * s2 - s1 * s1) / (m * (m - 1)))
    none = F.lit(None).cast("double")

    def cell(a, b, o, msd, ent, norm):
        return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), o.cast("double").alias("o"),
                        msd.alias("msd"), ent.alias("ent"), norm.alias("norm"))

    own = F.array(cell(F.lit(None), F.lit(None), F.lit(None), spread, h, norm))
    cells = F.flatten(F.transform("c", lambda x: F.transform("c", lambda y: cell(
        x["v"], y["v"], x["n"] * (y["n"] - F.when(x["v"] == y["v"], 1).otherwise(0)) / (m - 1), none, none, none))))
    rows = pi.select(*keys, F.explode(F.when(m >= 2, F.concat(own, cells)).otherwise(own)).alias("x")).select(*keys, "x.*")
    sums = rows.groupBy(*keys, "a", "b").agg(
        F.sum("o").alias("o"), F.avg("msd").alias("msd"), F.avg("ent").alias("ent"), F.avg("norm").alias("norm"))
    g = sums.groupBy(*keys).agg(
        F.max("msd").alias("msd"), F.max("ent").alias("entropy"), F.max("norm").alias("norm_entropy"),
        F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b", "o"))).alias("o"))
    # Pairable values with their marginals n_a = sum_b o_ab (integers) and running sums.
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda t, x: t + f(x))
    values = F.array_sort(F.array_distinct(F.transform("o", lambda x: x["a"])))
    g = g.withColumn("v", F.transform(values, lambda v: F.struct(
        v.alias("v"), F.round(total(F.filter("o", lambda x: x["a"] == v), lambda x: x["o"])).alias("n"))))
    g = g.withColumn("v", F.transform("v", lambda x: F.struct(
        x["v"].alias("v"), x["n"].alias("n"), total(F.filter("v", lambda y: y["v"] <= x["v"]), lambda y: y["n"]).alias("cn"))))
    g = g.withColumn("pairable", total("v", lambda x: x["n"]))

    def d2(x, y, level):
        if level == "nominal":
            return F.when(x["v"] == y["v"], 0.0).otherwise(1.0)
        if level == "interval":
            return (x["v"] - y["v"]) * (x["v"] - y["v"])
        span = F.greatest(x["cn"], y["cn"]) - F.least(x["cn"] - x["n"], y["cn"] - y["n"]) - (x["n"] + y["n"]) / 2.0
        return F.when(x["v"] == y["v"], 0.0).otherwise(span * span)

    def alpha(level):
        at = lambda v: F.filter("v", lambda x: x["v"] == v)[0]
        do = total("o", lambda c: c["o"] * d2(at(c["a"]), at(c["b"]), level))
        de = total("v", lambda x: total("v", lambda y: x["n"] * y["n"] * d2(x, y, level)))
        return (1.0 - (F.col("pairable") - 1) * F.try_divide(do, de)).alias(f"alpha_{level}")

    return g.select(*keys, "msd", "entropy", "norm_entropy", "pairable", *[alpha(x) for x in LEVELS])


def interval_alpha_simple(ratings: DataFrame, by=None) -> DataFrame:
    """alpha = 1 - MSD / D_e with D_e = 2 sum_{a<b} n_a n_b (a-b)^2 / (n (n-1))
    over pooled values (equals interval alpha when every item has equal c).
    D_e uses the identity sum_{a<b} n_a n_b (a-b)^2 = n sum n_v v^2 - (sum n_v v)^2,
    so it is one more aggregate; the per-group figures are combined by a
    union + group-by instead of a join."""
    ratings, keys, extra = _with_group(ratings, by)
    d_o = item_msd(ratings, keys).select(*keys, F.col("msd"), F.lit(None).cast("double").alias("de"))
    x = F.col("score").cast("double")
    pooled = ratings.groupBy(*keys).agg(F.count("score").alias("n"), F.sum(x).alias("s1"),
                                        F.sum(x * x).alias("s2"))
    de = pooled.select(*keys, F.lit(None).cast("double").alias("msd"),
                       (2.0 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1"))
                        / (F.col("n") * (F.col("n") - 1))).alias("de"))
    g = d_o.unionByName(de).groupBy(*keys).agg(F.avg("msd").alias("msd"), F.max("de").alias("de"))
    return g.select(*keys, (1.0 - F.try_divide(F.col("msd"), F.col("de"))).alias("alpha")).drop(*extra)


# ------------------------------------------------------------ Fleiss kappa
def category_table(ratings: DataFrame, categories=range(5), by=None) -> DataFrame:
    """Items x categories count table (one column per category). An item
    without a rating inside ``categories`` is a row of zeros."""
    return ratings.groupBy(*_keys(by), "item").agg(
        *[F.count_if(F.col("score") == v).alias(f"n_{v}") for v in categories])


def fleiss_kappa(ratings: DataFrame, categories=range(5), by=None) -> DataFrame:
    """Fleiss' kappa over the items x categories count table (ratings outside
    ``categories`` are ignored). It is defined for one number of ratings per
    item only; a ragged table gives null."""
    ratings, keys, extra = _with_group(ratings, by)
    cols = [F.col(f"n_{v}") for v in categories]
    ni = reduce(lambda a, b: a + b, cols)
    t = category_table(ratings, categories, keys).groupBy(*keys).agg(
        F.min(ni).cast("double").alias("least"), F.max(ni).cast("double").alias("r"),
        F.count(F.lit(1)).cast("double").alias("items"), F.sum(ni).cast("double").alias("total"),
        F.sum(reduce(lambda a, b: a + b, [c * c for c in cols])).cast("double").alias("sn2"),
        *[F.sum(c).cast("double").alias(f"s_{i}") for i, c in enumerate(cols)])
    snj2 = reduce(lambda a, b: a + b, [F.col(f"s_{i}") * F.col(f"s_{i}") for i in range(len(cols))])
    pe = F.try_divide(snj2, F.col("total") * F.col("total"))
    # mean_i (sum_j n_ij^2 - r) / (r (r - 1))
    pbar = F.try_divide(F.col("sn2") - F.col("items") * F.col("r"), F.col("items") * F.col("r") * (F.col("r") - 1))
    kappa = F.when(F.col("least") == F.col("r"), F.try_divide(pbar - pe, 1 - pe))
    return t.select(*keys, kappa.alias("kappa")).drop(*extra)


# ------------------------------------------------------------- group/pool
def with_all_group(ratings: DataFrame, group_col: str = "group") -> DataFrame:
    """Each rating once in its own group and once in ``'all'``."""
    return ratings.withColumn(group_col, F.explode(F.array(F.lit("all"), F.col(group_col))))


def pool_counts(ratings: DataFrame, categories=range(5)) -> DataFrame:
    """Per-item value counts tagged with each pool the item belongs to:
    ``(pool, item, c, m)``. Built from the <= K-entry count lists, so a hot
    item never meets a join on raw ratings."""
    cats = [int(v) for v in categories]
    pi = per_item_counts(ratings, [])
    present = F.transform(F.filter("c", lambda x: x["v"].isin(cats)), lambda x: x["v"])
    return pi.select(F.explode(present).alias("pool"), "item", "c", "m")


# --------------------------------------------------------------- Wilcoxon
def paired_item_msd(ratings: DataFrame, first: str, second: str, group_col: str = "group") -> DataFrame:
    """Per item ``d = msd(first group) - msd(second group)``, both from one
    grouped pass; items without two ratings in each group are left out."""
    x = F.col("score").cast("double")

    def sums(g):
        mine = F.when(F.col(group_col) == g, x)
        return [F.count(mine).alias("c"), F.sum(mine).alias("s"), F.sum(mine * mine).alias("ss")]

    cols = [c.alias(f"{n}{k}") for k, g in enumerate((first, second)) for n, c in zip(("c", "s", "ss"), sums(g))]
    t = ratings.groupBy("item").agg(*cols).where((F.col("c0") >= 2) & (F.col("c1") >= 2))
    m = [2.0 * (F.col(f"c{k}") * F.col(f"ss{k}") - F.col(f"s{k}") * F.col(f"s{k}"))
         / (F.col(f"c{k}") * (F.col(f"c{k}") - 1)) for k in (0, 1)]
    return t.select("item", (m[0] - m[1]).alias("d"))


STEP = 1024  # steps of |d| per unit; rating scales span a few units


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (relative error below 1.2e-7,
    Chebyshev fit; fixed values)."""
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = reduce(lambda acc, c: acc * t + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    return t * F.exp(-x * x + poly)


EXACT_PAIRS = 50


def exact_signed_rank_p(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller rank sum ``w`` over ``n`` untied pairs: how many
    of the 2**n signs give a sum of at most ``w``, by adding one rank after the
    other to the counts per sum."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (n * (n + 1) / 2).cast("int")))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda c, k: F.transform(
        c, lambda v, i: v + F.when(i >= k, F.get(c, i - k)).otherwise(F.lit(0.0))))
    below = F.aggregate(F.slice(counts, 1, w.cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def wilcoxon_signed_rank(diffs: DataFrame, col: str = "d", digits: int = 9) -> DataFrame:
    """W+, W-, W = min, n (non-zero pairs), the tie-corrected normal z and a
    two-sided p_value: exact for 1 to EXACT_PAIRS non-zero pairs without ties
    among the absolute differences, that of z for all others (null where all
    differences are zero).

    Ranks of |d| with ties averaged come from the distinct |d| values and
    their counts: rank = (#values below) + (t + 1) / 2. The counts below are
    those of the coarse steps below (one row per step) plus those inside the
    value's own step: one lazy plan, never a row-level sort.
    """
    d = diffs.select(F.round(F.col(col), digits).alias("d")).filter(F.col("d") != 0)
    byv = d.groupBy(F.abs("d").alias("v")).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("tp"))
    byv = byv.withColumn("step", F.floor(F.col("v") * STEP))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # one row per step
    steps = byv.groupBy("step").agg(F.sum("t").alias("n")).select(
        "step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("under"))
    inside = Window.partitionBy("step").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    r = byv.join(steps, "step").withColumn(
        "rank", F.col("under") + F.coalesce(F.sum("t").over(inside), F.lit(0)) + (F.col("t") + 1) / 2.0)
    agg = r.agg(F.sum(F.col("rank") * F.col("tp")).alias("w_plus"),
                F.sum(F.col("rank") * (F.col("t") - F.col("tp"))).alias("w_minus"),
                F.sum("t").alias("n"),
                F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    wmin = F.least("w_plus", "w_minus")
    z = (wmin - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    untied = F.col("n").between(1, EXACT_PAIRS) & (F.col("ties") == 0)
    exact = F.when(untied, exact_signed_rank_p(wmin, F.col("n"))).alias("exact")
    return agg.select(exact, F.col("n").cast("long").alias("n"), F.col("w_plus").cast("double").alias("w_plus"),
                      F.col("w_minus").cast("double").alias("w_minus"),
                      wmin.cast("double").alias("w"), z.alias("z")).withColumn(
        "p_value", F.coalesce("exact", _erfc(F.abs("z") / math.sqrt(2.0)))).drop("exact")


def wilcoxon_test(ratings: DataFrame, first: str, second: str, group_col: str = "group") -> dict:
    """Paired signed-rank test of per-item MSD between two rater groups, as a
    dict of the one aggregated row."""
    return wilcoxon_signed_rank(paired_item_msd(ratings, first, second, group_col)).first().asDict()
