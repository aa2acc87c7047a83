"""Agreement queries over two ratings sources: ``v_ratings`` (events: many
raters, missing ratings) and the six-rater panel ``v_panel``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import agreement as G
from ..sources import fixtures as V
from .registry import register

GROUPS = {"s0": "own", "s1": "own", "s2": "own", "s3": "external", "s4": "external", "s5": "external"}


def ratings_events(spark, sf):
    return V.v_ratings(spark, sf).select(F.col("item_id").alias("item"),
                                         F.col("rater_id").alias("rater"), "score")


def ratings_panel(spark, sf):
    p = V.v_panel(spark, sf)
    return G.wide_to_ratings(p, "doc_id", [f"s{j}" for j in range(6)], GROUPS)


def _both(spark, sf, fn, cols):
    a = fn(ratings_events(spark, sf)).withColumn("dataset", F.lit("ratings"))
    b = fn(ratings_panel(spark, sf).drop("group")).withColumn("dataset", F.lit("panel"))
    return a.unionByName(b).select("dataset", *[F.round(c, 6).alias(c) for c in cols])


# ------------------------------------------------------------ oracle SQL
R_EVENTS = "SELECT item_id AS item, rater_id AS rater, score FROM v_ratings"
R_PANEL = """SELECT doc_id AS item, rater, score,
    CASE WHEN rater IN ('s0', 's1', 's2') THEN 'own' ELSE 'external' END AS grp
    FROM (UNPIVOT (SELECT doc_id, s0, s1, s2, s3, s4, s5 FROM v_panel)
          ON s0, s1, s2, s3, s4, s5 INTO NAME rater VALUE score)"""
PANEL_VIEWS = ("v_panel", "v_ratings")


def _k(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _on(keys, a, b, extra=()):
    conds = [f"{a}.{k} = {b}.{k}" for k in list(keys) + list(extra)]
    return " AND ".join(conds) if conds else "TRUE"


def msd_sql(src, keys=()):
    k = _k(keys)
    return f"""(SELECT {k}avg(2.0 * (c * ss - s * s) / (c * (c - 1))) AS msd FROM (
        SELECT {k}item, count(score) AS c, sum(score) AS s, sum(score * score) AS ss
        FROM ({src}) GROUP BY {k}item) WHERE c >= 2 {"GROUP BY " + ", ".join(keys) if keys else ""})"""


def alpha_sql(src, level, keys=()):
    k = _k(keys)
    if level == "nominal":
        d2 = "CASE WHEN va.score = vb.score THEN 0.0 ELSE 1.0 END"
    elif level == "ordinal":
        d2 = ("CASE WHEN va.score = vb.score THEN 0.0 ELSE power(greatest(va.cn, vb.cn) - "
              "least(va.cn - va.nc, vb.cn - vb.nc) - (va.nc + vb.nc) / 2.0, 2) END")
    else:
        d2 = "power(va.score - vb.score, 2)"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    gb = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""(WITH u AS (SELECT {k}item, score, count(*) AS n FROM ({src}) WHERE score IS NOT NULL GROUP BY {k}item, score),
      m AS (SELECT {k}item, sum(n) AS m FROM u GROUP BY {k}item HAVING sum(n) >= 2),
      u2 AS (SELECT u.*, m.m FROM u JOIN m ON {_on(keys, 'u', 'm', ['item'])}),
      nv AS (SELECT {k}score, sum(n) AS nc FROM u2 GROUP BY {k}score),
      nv2 AS (SELECT *, sum(nc) OVER ({part} ORDER BY score) AS cn, sum(nc) OVER ({part}) AS ntot FROM nv),
      o AS (SELECT {_k(keys, 'a.')}a.score AS a, b.score AS b,
              sum(a.n * (b.n - CASE WHEN a.score = b.score THEN 1 ELSE 0 END) / (a.m - 1)) AS o
            FROM u2 a JOIN u2 b ON {_on(keys, 'a', 'b', ['item'])} GROUP BY ALL),
      pairs AS (SELECT {_k(keys, 'va.')}va.score AS a, vb.score AS b, CAST(va.nc * vb.nc AS DOUBLE) AS e,
              va.ntot AS ntot, {d2} AS d2 FROM nv2 va JOIN nv2 vb ON {_on(keys, 'va', 'vb')})
      SELECT {k}1 - (max(ntot) - 1) * sum(coalesce(o.o, 0) * d2) / sum(e * d2) AS alpha
      FROM pairs LEFT JOIN o USING ({k}a, b) {gb})"""


def entropy_sql(src, keys=()):
    k = _k(keys)
    gb = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""(SELECT {k}avg(h) AS entropy, avg(CASE WHEN kk > 1 THEN h / log2(kk) ELSE 0.0 END) AS norm_entropy
      FROM (SELECT {k}item, -sum(p * log2(p)) AS h, count(*) AS kk FROM (
          SELECT {k}item, score, n / sum(n) OVER (PARTITION BY {k}item) AS p
          FROM (SELECT {k}item, score, count(*) AS n FROM ({src}) WHERE score IS NOT NULL GROUP BY {k}item, score))
        GROUP BY {k}item) {gb})"""


# ------------------------------------------------------------- queries
@register("msd", f"""SELECT 'ratings' AS dataset, round(msd, 6) AS msd FROM {msd_sql(R_EVENTS)}
    UNION ALL SELECT 'panel', round(msd, 6) FROM {msd_sql(R_PANEL)}""", PANEL_VIEWS)
def msd(spark, sf):
    return _both(spark, sf, lambda r: G.msd(r), ["msd"])


@register("item_msd", f"""SELECT item, CAST(count(score) AS BIGINT) AS c,
    round(2.0 * (count(score) * sum(score * score) - sum(score) * sum(score))
          / (count(score) * (count(score) - 1)), 6) AS msd
    FROM ({R_EVENTS}) GROUP BY item HAVING count(score) >= 2""", PANEL_VIEWS)
def item_msd(spark, sf):
    m = G.item_msd(ratings_events(spark, sf))
    return m.select("item", F.col("c").cast("long"), F.round("msd", 6).alias("msd"))


def _alpha_q(level):
    sql = f"""SELECT 'ratings' AS dataset, round(alpha, 6) AS alpha FROM {alpha_sql(R_EVENTS, level)}
      UNION ALL SELECT 'panel', round(alpha, 6) FROM {alpha_sql(R_PANEL, level)}"""

    def q(spark, sf):
        return _both(spark, sf, lambda r: G.krippendorff_alpha(r, level), ["alpha"])
    return sql, q


for _lvl in ("nominal", "ordinal", "interval"):
    _sql, _q = _alpha_q(_lvl)
    register(f"alpha_{_lvl}", _sql, PANEL_VIEWS)(_q)


@register("alpha_interval_simple", f"""WITH r AS ({R_PANEL}),
    p AS (SELECT score, count(*) AS n FROM r GROUP BY score),
    de AS (SELECT 2.0 * sum(a.n * b.n * power(a.score - b.score, 2)) / ((SELECT sum(n) FROM p) * ((SELECT sum(n) FROM p) - 1)) AS de
           FROM p a JOIN p b ON a.score < b.score)
    SELECT round(1 - (SELECT msd FROM {msd_sql('SELECT * FROM r')}) / de, 6) AS alpha FROM de""", PANEL_VIEWS)
def alpha_interval_simple(spark, sf):
    a = G.interval_alpha_simple(ratings_panel(spark, sf).drop("group"))
    return a.select(F.round("alpha", 6).alias("alpha"))


@register("fleiss_kappa", f"""WITH r AS ({R_PANEL}),
    c AS (SELECT item, score, count(*) AS n FROM r WHERE score BETWEEN 0 AND 4 GROUP BY item, score),
    pi AS (SELECT item, sum(n) AS ni, sum(n * n) AS n2 FROM c GROUP BY item),
    g AS (SELECT CASE WHEN min(ni) = max(ni) AND count(*) = (SELECT count(DISTINCT item) FROM r) THEN max(ni) END AS rr,
            count(*) AS items, sum(ni) AS total, sum(n2) AS sn2 FROM pi),
    pe AS (SELECT sum(power(nj / (SELECT total FROM g), 2)) AS pe FROM (SELECT score, sum(n) AS nj FROM c GROUP BY score))
    SELECT round((((sn2 - items * rr) / (items * rr * (rr - 1))) - pe) / (1 - pe), 6) AS kappa FROM g, pe""",
          PANEL_VIEWS)
def fleiss_kappa(spark, sf):
    k = G.fleiss_kappa(ratings_panel(spark, sf).drop("group"))
    return k.select(F.round("kappa", 6).alias("kappa"))


@register("mean_entropy", f"""SELECT dataset, round(entropy, 6) AS entropy, round(norm_entropy, 6) AS norm_entropy
    FROM (SELECT 'ratings' AS dataset, * FROM {entropy_sql(R_EVENTS)}
          UNION ALL SELECT 'panel', * FROM {entropy_sql(R_PANEL)})""", PANEL_VIEWS)
def mean_entropy(spark, sf):
    return _both(spark, sf, lambda r: G.mean_entropy(r), ["entropy", "norm_entropy"])


@register("item_entropy", f"""SELECT item, round(-sum(p * log2(p)), 6) AS entropy,
    round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END, 6) AS norm_entropy
    FROM (SELECT item, score, n / sum(n) OVER (PARTITION BY item) AS p
          FROM (SELECT item, score, count(*) AS n FROM ({R_EVENTS}) GROUP BY item, score)) GROUP BY item""",
          PANEL_VIEWS)
def item_entropy(spark, sf):
    e = G.item_entropy(ratings_events(spark, sf))
    return e.select("item", F.round("entropy", 6).alias("entropy"),
                    F.round("norm_entropy", 6).alias("norm_entropy"))


R_GROUPED = f"SELECT item, rater, score, grp FROM ({R_PANEL}) UNION ALL SELECT item, rater, score, 'all' FROM ({R_PANEL})"


@register("agreement_by_group", f"""SELECT m.grp, round(m.msd, 6) AS msd, round(a.alpha, 6) AS alpha_ordinal,
    round(e.norm_entropy, 6) AS norm_entropy
    FROM {msd_sql(R_GROUPED, ['grp'])} m JOIN {alpha_sql(R_GROUPED, 'ordinal', ['grp'])} a USING (grp)
    JOIN {entropy_sql(R_GROUPED, ['grp'])} e USING (grp)""", PANEL_VIEWS)
def agreement_by_group(spark, sf):
    r = G.with_all_group(ratings_panel(spark, sf)).withColumnRenamed("group", "grp")
    t = G.statistics_from_counts(G.per_item_counts(r, ["grp"]), ["grp"])
    return t.select("grp", *[F.round(c, 6).alias(c) for c in ("msd", "alpha_ordinal", "norm_entropy")])


R_POOLS = f"""SELECT r.item, r.rater, r.score, p.pool FROM ({R_PANEL}) r
    JOIN (SELECT DISTINCT item, score AS pool FROM ({R_PANEL}) WHERE score BETWEEN 0 AND 4) p USING (item)"""


@register("agreement_by_pool", f"""SELECT CAST(m.pool AS BIGINT) AS pool, round(m.msd, 6) AS msd,
    round(a.alpha, 6) AS alpha_ordinal, round(n.alpha, 6) AS alpha_nominal
    FROM {msd_sql(R_POOLS, ['pool'])} m JOIN {alpha_sql(R_POOLS, 'ordinal', ['pool'])} a USING (pool)
    JOIN {alpha_sql(R_POOLS, 'nominal', ['pool'])} n USING (pool)""", PANEL_VIEWS)
def agreement_by_pool(spark, sf):
    t = G.statistics_from_counts(G.pool_counts(ratings_panel(spark, sf).drop("group")), ["pool"])
    return t.select(F.col("pool").cast("long"),
                    *[F.round(c, 6).alias(c) for c in ("msd", "alpha_ordinal", "alpha_nominal")])


@register("wilcoxon", f"""WITH r AS ({R_PANEL}),
    im AS (SELECT grp, item, 2.0 * (count(*) * sum(score * score) - sum(score) * sum(score)) / (count(*) * (count(*) - 1)) AS msd
           FROM r GROUP BY grp, item),
    d AS (SELECT round(a.msd - b.msd, 9) AS d FROM im a JOIN im b ON a.item = b.item AND a.grp = 'own' AND b.grp = 'external'),
    v AS (SELECT abs(d) AS v, count(*) AS t, count(*) FILTER (WHERE d > 0) AS tp FROM d WHERE d <> 0 GROUP BY abs(d)),
    rk AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rnk FROM v),
    ag AS (SELECT sum(rnk * tp) AS wp, sum(rnk * (t - tp)) AS wm, sum(t) AS n, sum(power(t, 3) - t) AS ties FROM rk),
    zz AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM ag)
    SELECT CAST(n AS BIGINT) AS n, round(CAST(wp AS DOUBLE), 6) AS w_plus, round(CAST(wm AS DOUBLE), 6) AS w_minus,
      round(CAST(least(wp, wm) AS DOUBLE), 6) AS w, round(z, 6) AS z,
      round(1 - 2 / sqrt(2 * pi()) * (SELECT sum(exp(-power(x, 2) / 2)) * abs(z) / 20000 FROM (
        SELECT (i + 0.5) / 20000 * abs(z) AS x FROM range(20000) t(i))), 6) AS p_value
    FROM zz""", PANEL_VIEWS)
def wilcoxon(spark, sf):
    d = G.paired_item_msd(ratings_panel(spark, sf), "own", "external")
    w = G.wilcoxon_signed_rank(d)
    return w.select("n", *[F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "w", "z", "p_value")])


@register("label_counts", """SELECT label, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(educational_value_labels, '''(.*?)''', 1)) AS label FROM v_panel_text)
    GROUP BY label""", ("v_panel_text",))
def label_counts(spark, sf):
    p = V.v_panel_text(spark, sf)
    return (p.select(F.explode(S.parse_list_text("educational_value_labels")).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@register("panel_eligible", """SELECT doc_id FROM v_panel_text
    WHERE len(regexp_extract_all(educational_value_labels, '''(.*?)''', 1)) > 2
      AND list_contains(regexp_extract_all(educational_value_labels, '''(.*?)''', 1), 'Excellent')""",
          ("v_panel_text",))
def panel_eligible(spark, sf):
    p = V.v_panel_text(spark, sf).select("doc_id", S.parse_list_text("educational_value_labels").alias("l"))
    return p.filter((F.size("l") > 2) & F.arrays_overlap("l", F.array(F.lit("Excellent")))).select("doc_id")



@register("category_table", f"""SELECT item, {", ".join(
    f"count(*) FILTER (WHERE score = {v}) AS n_{v}" for v in range(5))}
    FROM ({R_PANEL}) GROUP BY item""", PANEL_VIEWS)
def category_table(spark, sf):
    return G.category_table(ratings_panel(spark, sf).drop("group"))


@register("pooled_score_histogram", f"""SELECT CAST(d.v AS INTEGER) AS score, coalesce(c.n, 0) AS n FROM range(5) d(v)
    LEFT JOIN (SELECT score, count(*) AS n FROM ({R_PANEL}) GROUP BY score) c ON c.score = d.v""", PANEL_VIEWS)
def pooled_score_histogram(spark, sf):
    """All panel annotations pooled into unit bins 0..4 (zeros kept)."""
    from ..operators.corpus import score_distribution
    return score_distribution(spark, ratings_panel(spark, sf), "score", range(5))


# Ratings with missing ones: every seventh event keeps its rater but no score.
R_GAPS = "SELECT item, rater, CASE WHEN rater % 7 = 3 THEN NULL ELSE score END AS score FROM (" + R_EVENTS + ")"


@register("agreement_with_gaps", f"""WITH r AS ({R_GAPS}),
    x AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY rater, score) AS i, score FROM r WHERE score IS NOT NULL),
    m AS (SELECT item, count(*) AS m FROM x GROUP BY item HAVING count(*) >= 2),
    pairs AS (SELECT a.item, a.score AS a, b.score AS b, m.m FROM x a JOIN x b ON a.item = b.item AND a.i <> b.i
              JOIN m ON m.item = a.item),
    pooled AS (SELECT x.score AS v FROM x JOIN m USING (item)),
    c AS (SELECT v, count(*) AS n FROM pooled GROUP BY v),
    obs AS (SELECT sum(CASE WHEN a <> b THEN 1.0 / (m - 1) ELSE 0 END) / (SELECT count(*) FROM pooled) AS d,
                   sum(power(a - b, 2) / (m - 1)) / (SELECT count(*) FROM pooled) AS e FROM pairs),
    expd AS (SELECT sum(CASE WHEN p.v <> q.v THEN p.n * q.n ELSE 0 END) / ((SELECT count(*) FROM pooled) * ((SELECT count(*) FROM pooled) - 1.0)) AS d,
                    sum(power(p.v - q.v, 2) * p.n * q.n) / ((SELECT count(*) FROM pooled) * ((SELECT count(*) FROM pooled) - 1.0)) AS e
             FROM c p, c q),
    h AS (SELECT item, -sum(n / t * log2(n / t)) AS h FROM (
            SELECT item, score, count(*) AS n, sum(count(*)) OVER (PARTITION BY item) AS t FROM x GROUP BY item, score) GROUP BY item)
    SELECT round(1 - obs.d / expd.d, 6) AS alpha_nominal, round(1 - obs.e / expd.e, 6) AS alpha_interval,
      (SELECT round(avg(h), 6) FROM h) AS entropy,
      (SELECT round(avg(d), 6) FROM (SELECT item, avg(power(a - b, 2)) AS d FROM pairs GROUP BY item)) AS msd
    FROM obs, expd""", PANEL_VIEWS)
def agreement_with_gaps(spark, sf):
    """Missing ratings take no part in any figure; the oracle works on pairs
    of ratings, as the statistics are defined."""
    r = ratings_events(spark, sf)
    r = r.withColumn("score", F.when(F.col("rater") % 7 == 3, F.lit(None)).otherwise(F.col("score")))
    t = G.statistics_from_counts(G.per_item_counts(r.withColumn("g", F.lit(0)), ["g"]), ["g"])
    return t.select(*[F.round(c, 6).alias(c) for c in ("alpha_nominal", "alpha_interval", "entropy", "msd")])
