"""Metric reports on scored, labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import metrics, ordered
from sigloom.plans.registry import Tables, query, r6

# Documents with a label, a probability that grows with length, and a stratum.
SCORED = """
WITH scored AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality AS y,
         round(1 / (1 + exp(-(ln(CAST(d.n_chars AS DOUBLE)) - 6.5))), 9) AS p,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'ptsd'
              WHEN l.toxic = 1 THEN 'somatoform'
              WHEN d.lang = 'en' THEN 'control_A'
              WHEN d.lang = 'de' THEN 'control_B'
              WHEN d.n_chars < 300 THEN 'control_ageing'
              ELSE 'control_C' END AS stratum
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def scored(t: Tables) -> DataFrame:
    p = F.round(1 / (1 + F.exp(-(F.ln(F.col("n_chars").cast("double")) - 6.5))), 9)
    stratum = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ptsd")
        .when(F.col("toxic") == 1, "somatoform")
        .when(F.col("lang") == "en", "control_A")
        .when(F.col("lang") == "de", "control_B")
        .when(F.col("n_chars") < 300, "control_ageing")
        .otherwise("control_C")
    )
    docs = t.documents.select("doc_id", "source", "lang", "n_chars")
    return docs.join(t.labels, "doc_id").select(
        "doc_id", "source", "lang", "n_chars", F.col("quality").alias("y"), p.alias("p"), stratum.alias("stratum")
    )


def is_ptsd() -> Column:
    return F.col("stratum") == "ptsd"


# rank-sum AUC of column s for label y within column g
RANK_AUC = """
SELECT g, round((sum(ar) FILTER (WHERE y = 1) - max(np) * (max(np) + 1) / CAST(2 AS DOUBLE)) / nullif(max(np) * max(nn), 0), 6) + 0.0 AS auc
FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / CAST(2 AS DOUBLE) AS ar,
             CAST(count(*) FILTER (WHERE y = 1) OVER (PARTITION BY g) AS DOUBLE) AS np,
             CAST(count(*) FILTER (WHERE y = 0) OVER (PARTITION BY g) AS DOUBLE) AS nn
      FROM {src})
GROUP BY g
"""


@query(
    "WITH e AS (SELECT d.source AS g, d.n_chars AS s, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
    "u AS (SELECT g, s, y FROM e UNION ALL SELECT '(all)', s, y FROM e) " + RANK_AUC.format(src="u")
)
def auc_rank(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    # one small count table per (source, length); the overall row is rolled up from it
    counts = rows.groupBy("source", "n_chars").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("p"), F.sum((F.col("quality") == 0).cast("long")).alias("q")
    )
    both = counts.select(F.explode(F.array("source", F.lit("(all)"))).alias("g"), "n_chars", "p", "q")
    signed = both.select("g", "n_chars", F.explode(F.array(
        F.struct(F.lit(True).alias("pos"), F.col("p").alias("w")), F.struct(F.lit(False).alias("pos"), F.col("q").alias("w"))
    )).alias("s")).select("g", "n_chars", "s.pos", "s.w").filter("w > 0")
    out = ordered.auc(signed, ["g"], "n_chars", F.col("pos"), F.col("w"))
    return out.select("g", r6("auc").alias("auc"))


@query(
    SCORED + ", strata AS (SELECT DISTINCT stratum FROM scored WHERE stratum <> 'ptsd'), "
    "u AS (SELECT k.stratum AS g, s.p AS s, CASE WHEN s.stratum = 'ptsd' THEN 1 ELSE 0 END AS y "
    "FROM strata k JOIN scored s ON s.stratum = 'ptsd' OR s.stratum = k.stratum), a AS (" + RANK_AUC.format(src="u") + ") "
    "SELECT a.g AS stratum, CAST((SELECT count(*) FROM scored s WHERE s.stratum = a.g) AS BIGINT) AS n, a.auc FROM a"
)
def auc_by_stratum(t: Tables) -> DataFrame:
    out = metrics.auc_against(scored(t), "p", is_ptsd(), "stratum")
    return out.select("stratum", "n", r6("auc").alias("auc"))


def _auc_sql(negative: str) -> str:
    return (
        "(SELECT (sum(CASE WHEN a.p > b.p THEN CAST(1 AS DOUBLE) WHEN a.p = b.p THEN 0.5 ELSE 0 END)) / count(*) "
        f"FROM scored a JOIN scored b ON a.stratum = 'ptsd' AND b.stratum IN ({negative}))"
    )


def _fpr_sql(*groups: str) -> str:
    parts = [f"(SELECT avg(CASE WHEN p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM scored WHERE stratum IN ({g}))" for g in groups]
    return f"list_avg([{', '.join(parts)}])"


@query(
    SCORED + f"""
SELECT round(30 * greatest(0, ({_auc_sql("'control_A','control_B','control_C','control_ageing'")} - 0.5) / 0.5)
             + 20 * (1 - {_fpr_sql("'somatoform'")}), 6) AS score_controls,
       round(30 * greatest(0, ({_auc_sql("'control_A','control_B','somatoform'")} - 0.5) / 0.5)
             + 20 * (1 - {_fpr_sql("'control_A'", "'control_B'", "'somatoform'")}), 6) AS score_groups,
       round(30 * greatest(0, ({_auc_sql("'control_A','control_B'")} - 0.5) / 0.5)
             + 20 * (1 - {_fpr_sql("'control_ageing'", "'somatoform'")}), 6) AS score_specific,
       round(30 * greatest(0, ({_auc_sql("'control_A','control_B','control_C'")} - 0.5) / 0.5)
             + 20 * greatest(0, ({_auc_sql("'control_ageing','somatoform'")} - 0.5) / 0.5), 6) AS score_free,
       round({_auc_sql("'control_A','control_B','control_C','control_ageing','somatoform'")}, 6) AS auc_all
"""
)
def score_formula(t: Tables) -> DataFrame:
    rows, s = scored(t), F.col("stratum")
    is_ = lambda *names: s.isin(*names)
    one = metrics.selection_score(rows, [], "p", is_ptsd(), s.startswith("control_"), [is_("somatoform")], "score_controls")
    two = metrics.selection_score(
        rows, [], "p", is_ptsd(), is_("control_A", "control_B", "somatoform"),
        [is_("control_A"), is_("control_B"), is_("somatoform")], "score_groups",
    )
    three = metrics.selection_score(
        rows, [], "p", is_ptsd(), is_("control_A", "control_B"), [is_("control_ageing"), is_("somatoform")], "score_specific"
    )
    free = metrics.selection_score_two_aucs(
        rows, [], "p", is_ptsd(), is_("control_A", "control_B", "control_C"), is_("control_ageing", "somatoform"), "score_free"
    )
    every = ordered.auc(rows, [], "p", is_ptsd(), name="auc_all")
    out = one
    for other in (two, three, free, every):  # every frame is one row
        out = out.crossJoin(F.broadcast(other))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    SCORED + """
SELECT CASE WHEN grouping(stratum) = 1 THEN '(all)' ELSE stratum END AS stratum, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN stratum0 = 'ptsd' THEN h END), 6) AS sensitivity,
       round(avg(CASE WHEN stratum0 <> 'ptsd' THEN 1 - h END), 6) AS specificity,
       round(0.5 * (avg(CASE WHEN stratum0 = 'ptsd' THEN h END) + avg(CASE WHEN stratum0 IN ('control_A','control_B') THEN 1 - h END)), 6) AS balanced_vs_controls,
       round(0.5 * (avg(CASE WHEN stratum0 = 'ptsd' THEN h END) + avg(CASE WHEN stratum0 <> 'ptsd' THEN 1 - h END)), 6) AS balanced_vs_all
FROM (SELECT stratum, stratum AS stratum0, CASE WHEN p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS h FROM scored)
GROUP BY GROUPING SETS ((stratum), ())
"""
)
def threshold_metrics(t: Tables) -> DataFrame:
    out = metrics.threshold_metrics(scored(t), "p", is_ptsd(), F.col("stratum").isin("control_A", "control_B"), "stratum")
    cols = ("sensitivity", "specificity", "balanced_vs_controls", "balanced_vs_all")
    return out.select("stratum", "n", *[r6(c).alias(c) for c in cols])


@query(
    SCORED + """, z AS (SELECT stratum, round(ln(p / (1 - p)), 9) AS z FROM scored),
k AS (SELECT CASE WHEN stratum = 'ptsd' THEN 1 ELSE 0 END AS y, z FROM z WHERE stratum IN ('ptsd', 'control_ageing', 'somatoform')),
v AS (SELECT DISTINCT z FROM k),
m AS (SELECT z, lead(z) OVER (ORDER BY z) AS nz, min(z) OVER () AS lo FROM v),
c AS (SELECT coalesce((z + nz) / 2, z + 1) AS cut FROM m UNION ALL SELECT min(z) - 1 FROM v),
g AS (SELECT cut, abs(avg(CASE WHEN y = 1 THEN CASE WHEN z >= cut THEN CAST(1 AS DOUBLE) ELSE 0 END END)
                      - avg(CASE WHEN y = 0 THEN CASE WHEN z < cut THEN CAST(1 AS DOUBLE) ELSE 0 END END)) AS gap
      FROM c CROSS JOIN k GROUP BY cut)
SELECT round(quantile_cont(cut, 0.5), 6) AS shift FROM g, (SELECT min(gap) AS b FROM g) WHERE gap - b <= 1e-8 + 1e-5 * b
"""
)
def equal_error(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("z", F.round(F.ln(F.col("p") / (1 - F.col("p"))), 9))
    out = metrics.equal_error_shift(rows, "z", is_ptsd(), F.col("stratum").isin("control_ageing", "somatoform"))
    return out.select(r6("shift").alias("shift"))


@query(
    SCORED + """, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM scored),
b AS (SELECT s.p, s.y, len(list_filter(e.e[2:len(e.e) - 1], lambda x: x < s.p)) AS bin FROM scored s, e)
SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM b GROUP BY bin
"""
)
def reliability(t: Tables) -> DataFrame:
    out = metrics.reliability(scored(t), "p", F.col("y"))
    return out.select("bin", "n", r6("mean_p").alias("mean_p"), r6("observed").alias("observed"))


@query(
    SCORED + """
SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(pow(p - y, 2)), 6) AS brier,
       round(-avg(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))), 6) AS log_loss
FROM scored GROUP BY lang
"""
)
def brier_logloss(t: Tables) -> DataFrame:
    out = metrics.brier_and_log_loss(scored(t), ["lang"], "p", F.col("y"))
    return out.select("lang", "n", r6("brier").alias("brier"), r6("log_loss").alias("log_loss"))


BANDS = (("short", 0.0, 200.0), ("medium", 200.0, 800.0), ("long", 800.0, 3000.0), ("longest", 3000.0, float("inf")))


@query(
    SCORED + """, bands(band, lo, hi) AS (VALUES ('short', 0, 200), ('medium', 200, 800), ('long', 800, 3000), ('longest', 3000, 999999999)),
n AS (SELECT b.band, s.p FROM bands b JOIN scored s ON s.n_chars >= b.lo AND s.n_chars < b.hi WHERE s.stratum <> 'ptsd'),
s AS (SELECT band, CAST(count(p) AS BIGINT) AS n, round(quantile_cont(p, 0.5), 6) AS median_p,
             round(avg(CASE WHEN p < 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS specificity FROM n GROUP BY band),
a AS (SELECT n.band, round(sum(CASE WHEN x.p > n.p THEN CAST(1 AS DOUBLE) WHEN x.p = n.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
      FROM n JOIN scored x ON x.stratum = 'ptsd' GROUP BY n.band)
SELECT b.band, coalesce(s.n, 0) AS n, s.median_p, s.specificity, a.auc FROM bands b LEFT JOIN s ON b.band = s.band LEFT JOIN a ON a.band = b.band
"""
)
def age_bands(t: Tables) -> DataFrame:
    rows = scored(t)
    band = F.lit(None)
    for name, lo, hi in reversed(BANDS):
        band = F.when((F.col("n_chars") >= lo) & (F.col("n_chars") < hi), name).otherwise(band)
    rest = rows.filter(~is_ptsd()).withColumn("band", band)
    per = rest.groupBy("band").agg(F.count("p").alias("n"), metrics.share(F.col("p") < 0.5).alias("specificity"))
    mid = ordered.median(rest, ["band"], "p", "median_p")
    area = metrics.auc_against(rows, "p", is_ptsd(), band).select(F.col("stratum").alias("band"), "auc")
    bands = t.spark.createDataFrame([(b,) for b, _, _ in BANDS], "band string")
    out = bands.join(per, "band", "left").join(mid, "band", "left").join(area, "band", "left")
    return out.select(
        "band", F.coalesce("n", F.lit(0)).alias("n"), r6("median_p").alias("median_p"),
        r6("specificity").alias("specificity"), r6("auc").alias("auc"),
    )


@query(
    """
WITH r AS (SELECT l_returnflag AS flag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / CAST(2 AS DOUBLE) AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / CAST(2 AS DOUBLE) AS rb
  FROM lineitem)
SELECT flag, CAST(count(*) AS BIGINT) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY flag
"""
)
def spearman(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return metrics.spearman(rows, ["flag"], "l_quantity", "l_extendedprice").select("flag", "n", r6("rho").alias("rho"))


@query(
    SCORED + """, v AS (SELECT p, sum(CASE WHEN stratum = 'ptsd' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS np,
  sum(CASE WHEN stratum <> 'ptsd' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS nn FROM scored GROUP BY p)
SELECT p AS threshold, round(sum(np) OVER (ORDER BY p DESC) / sum(np) OVER (), 6) AS tpr, round(sum(nn) OVER (ORDER BY p DESC) / sum(nn) OVER (), 6) AS fpr FROM v
"""
)
def roc_curve(t: Tables) -> DataFrame:
    out = metrics.roc_points(scored(t), "p", is_ptsd())
    return out.select("threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(
    """
WITH u AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY user_id, event_type)
SELECT event_type, CAST(count(*) AS BIGINT) AS n_subjects, round(avg(v), 6) AS mean_value, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem
FROM u GROUP BY event_type
"""
)
def subject_means(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return per.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        r6(F.avg("v")).alias("mean_value"),
        r6(F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("sem"),
    )


@query(
    """
WITH m AS (SELECT l_returnflag AS flag, l_quantity AS q, l_extendedprice AS y FROM lineitem),
g AS (SELECT flag, avg(y) AS mu, regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM m GROUP BY flag)
SELECT m.flag, round(1 - sum(pow(y - (a + b * q), 2)) / sum(pow(y - mu, 2)), 6) AS r2,
       round(avg(abs(y - (a + b * q))), 4) AS mae, round(avg(abs(y - mu)), 4) AS mae_mean
FROM m JOIN g ON m.flag = g.flag GROUP BY m.flag
"""
)
def fit_quality(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y"))
    fit = rows.groupBy("flag").agg(
        F.avg("y").alias("mu"), F.regr_slope("y", "q").alias("b"), F.regr_intercept("y", "q").alias("a")
    )
    err = F.col("y") - (F.col("a") + F.col("b") * F.col("q"))
    ref = F.col("y") - F.col("mu")
    return rows.join(fit, "flag").groupBy("flag").agg(
        r6(1 - F.sum(err * err) / F.sum(ref * ref)).alias("r2"),
        F.round(F.avg(F.abs(err)), 4).alias("mae"),
        F.round(F.avg(F.abs(ref)), 4).alias("mae_mean"),
    )


@query(
    SCORED + """, r AS (SELECT avg(CASE WHEN stratum = 'ptsd' THEN CASE WHEN p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END END) AS sens,
  avg(CASE WHEN stratum <> 'ptsd' THEN CASE WHEN p < 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END END) AS spec,
  avg(CASE WHEN stratum = 'ptsd' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS prior FROM scored),
q(prevalence) AS (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.3 AS DOUBLE)))
SELECT prevalence, round(sens * prevalence / (sens * prevalence + (1 - spec) * (1 - prevalence)), 6) AS ppv,
       round(spec * (1 - prevalence) / (spec * (1 - prevalence) + (1 - sens) * prevalence), 6) AS npv,
       round((prevalence / (1 - prevalence)) / (prior / (1 - prior)), 6) AS odds_factor FROM r, q
"""
)
def prevalence_odds(t: Tables) -> DataFrame:
    hit = F.col("p") >= 0.5
    rates = scored(t).agg(
        metrics.share(F.when(is_ptsd(), hit)).alias("sens"), metrics.share(F.when(~is_ptsd(), ~hit)).alias("spec"), metrics.share(is_ptsd()).alias("prior")
    )
    q = F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1, 0.3)))).alias("prevalence")
    q_, sens, spec, prior = F.col("prevalence"), F.col("sens"), F.col("spec"), F.col("prior")
    return rates.select("*", q).select(
        "prevalence",
        r6(sens * q_ / (sens * q_ + (1 - spec) * (1 - q_))).alias("ppv"),
        r6(spec * (1 - q_) / (spec * (1 - q_) + (1 - sens) * q_)).alias("npv"),
        r6((q_ / (1 - q_)) / (prior / (1 - prior))).alias("odds_factor"),
    )
