"""Cycle-folding queries on embeddings (64-sample cycles per label) and on the derived recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import cycles, features, recordings
from sigloom.plans.recordings import files
from sigloom.plans.registry import Tables, query, r6

HALF_SQL = """
WITH v AS (SELECT label, (vec_id % 2) AS half, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(0, 64) r(i)),
m AS (SELECT label, half, i, avg(x) AS x, count(*) AS n FROM v GROUP BY 1, 2, 3)
"""


def halves(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", (F.col("vec_id") % 2).cast("int").alias("half"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return cycles.mean_arrays(rows, ["label", "half"], "x", "mean")


@query(
    HALF_SQL + "SELECT a.label, CAST(max(a.n) AS BIGINT) AS n_even, CAST(max(b.n) AS BIGINT) AS n_odd, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) + 0.0 AS r "
    "FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY a.label"
)
def half_correlation(t: Tables) -> DataFrame:
    """Uncentred correlation of the even and odd averages."""
    pick = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    wide = halves(t).groupBy("label").agg(pick(0, "mean").alias("a"), pick(1, "mean").alias("b"), pick(0, "n_rows").alias("n_even"), pick(1, "n_rows").alias("n_odd"))
    dot = lambda u, v: F.aggregate(F.zip_with(F.col(u), F.col(v), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return wide.select("label", "n_even", "n_odd", r6(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("r"))


SPLIT_SQL = """
WITH v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS m, embedding FROM embeddings),
h AS (SELECT label, 'interleaved' AS split, vec_id % 2 AS half, embedding FROM v WHERE m >= 6 UNION ALL SELECT label, 'blocks', CASE WHEN i < m // 2 THEN 0 ELSE 1 END, embedding FROM v WHERE m >= 6),
x AS (SELECT label, split, half, j, avg(CAST(embedding[j + 1] AS DOUBLE)) AS x FROM h CROSS JOIN range(0, 64) r(j) GROUP BY ALL),
d AS (SELECT label, split, half, k, sum(x * cos(2 * pi() * k * j / 64)) AS re, -sum(x * sin(2 * pi() * k * j / 64)) AS im FROM x CROSS JOIN range(0, 33) q(k) GROUP BY ALL)
SELECT a.label, a.split, CAST(a.k AS INTEGER) AS bin, round((a.re * b.re + a.im * b.im) / sqrt((a.re * a.re + a.im * a.im) * (b.re * b.re + b.im * b.im)), 5) + 0.0 AS cosine
FROM d a JOIN d b ON a.label = b.label AND a.split = b.split AND a.k = b.k AND a.half = 0 AND b.half = 1 WHERE a.k BETWEEN 1 AND 31
"""


@query(SPLIT_SQL)
def phase_consistency(t: Tables) -> DataFrame:
    """Phase agreement of two halves per label, interleaved and in blocks; every vector is a cycle seen alike on both channels."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = t.embeddings.select(F.col("label").alias("path"), F.explode(F.array(*map(F.lit, cycles.FRONTAL))).alias("channel"), F.col("vec_id").alias("cycle"), x.alias("x"))
    out = cycles.split_phase_consistency(rows).filter("bin BETWEEN 1 AND 31")
    return out.select(F.col("path").alias("label"), "split", "bin", (F.round("cosine", 5) + 0.0).alias("cosine"))


@query(f"SELECT split, bin, CAST(count(*) AS BIGINT) AS n, round(avg(cosine), 7) + 0.0 AS mean_cosine FROM ({SPLIT_SQL}) GROUP BY split, bin")
def mean_phase_consistency(t: Tables) -> DataFrame:
    """Mean over the records of the cosine of the phase difference, per split and bin."""
    each = phase_consistency(t)
    return each.groupBy("split", "bin").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("cosine"), 7) + 0.0).alias("mean_cosine"))


@query()
def cycle_report(t: Tables) -> DataFrame:
    """Observed and randomised group statistics of the derived recordings."""
    h = cycles.half_spectra(cycles.good_cycles(files(t)))
    records = cycles.record_spectra(h).withColumn("subject", F.col("path"))
    out = cycles.report(records)
    return out.select("statistic", *[r6(c).alias(c) for c in ("observed", "null_mean", "null_q05", "null_q95", "p")])


@query()
def subject_features(t: Tables) -> DataFrame:
    """All 74 features in long form: two recordings a subject, the even one at rest and the odd one a task."""
    flagged = recordings.flagged_windows(files(t))
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    subject = F.concat(F.lit("sub-"), F.floor(number / 2).cast("string"))
    power = features.with_psd(flagged).withColumns({"subject_key": subject, "condition": F.when(number % 2 == 0, "rest").otherwise("task"), "trial": (number % 2).cast("int")})
    table = features.subject_features(power, flagged.select(subject.alias("subject_key")))
    long = table.unpivot("subject_key", list(features.FEATURE_NAMES), "feature", "value")
    return long.select("subject_key", "feature", r6("value").alias("value"))
