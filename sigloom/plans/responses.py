"""Averaged responses and filter diagnostics on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import diagnostics, erp
from sigloom.plans.registry import Tables, query, r6

CHANNELS = ("FCz", "FP1", "FP2", "C5", "C6", "O1", "O2")
T0, RATE = -0.1, 128.0


def responses(t: Tables) -> DataFrame:
    """ERP table: fourteen consecutive vectors are the seven channels of one subject, deviants first."""
    at = F.col("vec_id") % 14
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / 14).cast("string").alias("subject"), F.when(at < 7, erp.DEVIANT).otherwise(erp.STANDARD).alias("bin"),
        F.get(F.array(*map(F.lit, CHANNELS)), (at % 7).cast("int")).alias("channel"), F.lit(T0).alias("t0_s"), F.lit(RATE).alias("sfreq"), F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )
    whole = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n = 14").select("subject")
    return rows.join(whole, "subject", "left_semi")


def _summary_sql(label: str, sites: tuple[str, ...]) -> tuple[str, str]:
    """One view: its waves are named by a prefix of their own."""
    p, inside = label.lower(), ", ".join(f"'{s}'" for s in sites)
    waves = f"""{p}w AS (SELECT subject, i, round({T0} + i / {RATE}, 9) AS t, avg(v) FILTER (WHERE bin = 0) AS dv, avg(v) FILTER (WHERE bin = 1) AS sv FROM cells WHERE channel IN ({inside}) GROUP BY subject, i),
{p}s AS (SELECT subject, avg(dv - sv) AS m FROM {p}w WHERE t BETWEEN {erp.MMN_WINDOW_S[0]} AND {erp.MMN_WINDOW_S[1]} GROUP BY subject), {p}g AS (SELECT t, avg(dv - sv) AS d, avg(sv) AS st FROM {p}w GROUP BY t)"""
    late, early = f"FROM {p}g WHERE t BETWEEN 0.05 AND 0.40 ORDER BY abs(d) DESC, t LIMIT 1", f"FROM {p}g WHERE t BETWEEN 0.05 AND 0.20 ORDER BY st, t LIMIT 1"
    row = f"""SELECT '{label}' AS view, round(avg(m), 3) + 0.0 AS mmn_window_mean_uv, round(stddev_samp(m), 3) AS mmn_window_sd_uv, round(avg(CASE WHEN m < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 3) AS mmn_window_share_negative,
  round((SELECT d {late}), 3) + 0.0 AS difference_extremum_uv, round((SELECT t {late}), 4) AS difference_extremum_latency_s, round((SELECT sqrt(avg(d * d)) FROM {p}g WHERE t BETWEEN 0.0 AND 0.6), 3) AS difference_rms_0_600ms_uv,
  round((SELECT st {early}), 3) + 0.0 AS standard_n1_uv, round((SELECT t {early}), 4) AS standard_n1_latency_s FROM {p}s"""
    return waves, row


def _all_views() -> str:
    parts = [_summary_sql(label, sites) for label, sites, order in erp.VIEWS if order == 0]
    cells = "cells AS (SELECT vec_id // 14 AS subject, (vec_id % 14) // 7 AS bin, " + "CASE vec_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHANNELS)) + " END AS channel, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) r(i) WHERE vec_id // 14 IN (SELECT vec_id // 14 FROM embeddings GROUP BY 1 HAVING count(*) = 14))"
    return "WITH " + ", ".join([cells, *[w for w, _ in parts]]) + " " + " UNION ALL ".join(r for _, r in parts)


@query(_all_views())
def erp_summary(t: Tables) -> DataFrame:
    """Response measures of the unfiltered views."""
    out = erp.summary(responses(t), [v for v in erp.VIEWS if v[2] == 0])
    zero = ("mmn_window_mean_uv", "difference_extremum_uv", "standard_n1_uv")
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in zero})


@query(
    f"""WITH p AS (SELECT label, i * 0.1 AS f, avg(log10(CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) + 0.01)) AS y FROM embeddings CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2),
r AS (SELECT label, o AS "order", log10(f) AS x, y - log10(pow(f / {erp.HIGHPASS_HZ}, 2 * o) / (1 + pow(f / {erp.HIGHPASS_HZ}, 2 * o))) AS y FROM p CROSS JOIN range(1, 5) q(o) WHERE f BETWEEN 0.3 AND 6.45)
SELECT label, CAST("order" AS INTEGER) AS "order", round(regr_intercept(y, x), 6) + 0.0 AS c, round(-regr_slope(y, x), 6) + 0.0 AS chi, round(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 5) + 0.0 AS ssr FROM r GROUP BY 1, 2"""
)
def highpass_order(t: Tables) -> DataFrame:
    """Fit of every filter order to a spectrum per label; position i of a vector stands for i / 10 Hz."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).select("label", ((F.col("i") + 1) * 0.1).alias("freq"), F.log10(F.col("v").cast("double") * F.col("v").cast("double") + 0.01).alias("y"))
    spectrum = cells.groupBy("label", "freq").agg(F.avg("y").alias("log10_psd"))
    out = diagnostics.highpass_order_fit(spectrum, ["label"], band=(0.3, 6.45))
    return out.select("label", "order", r6("c").alias("c"), r6("chi").alias("chi"), (F.round("ssr", 5) + F.lit(0.0)).alias("ssr"))
