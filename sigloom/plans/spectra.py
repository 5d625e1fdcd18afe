"""Spectral queries: every embedding is one 64-sample window at 64 Hz, labels play the subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import ordered, spectral
from sigloom.plans.registry import Tables, query, r6

SFREQ, N = 64.0, 64
GRID = spectral.Grid(N, SFREQ)

PSD_SQL = """
WITH s AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) * 100 * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS x FROM embeddings CROSS JOIN range(0, 64) r(i)),
d AS (SELECT vec_id, label, k AS bin, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM s CROSS JOIN range(0, 33) q(k) GROUP BY 1, 2, 3),
psd AS (SELECT vec_id, label, vec_id % 4 AS rec, CAST(bin AS INTEGER) AS bin, CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END * (re * re + im * im) / (64 * 24) AS power FROM d),
lm AS (SELECT label, bin, avg(log10(power)) + 0.5772156649015329 / ln(10) AS ls FROM psd GROUP BY label, bin)
"""


def windows(t: Tables) -> DataFrame:
    x = F.transform(F.col("embedding"), lambda v: v.cast("double") * 100)
    return t.embeddings.select("vec_id", "label", (F.col("vec_id") % 4).alias("rec"), signal.psd(x, SFREQ).alias("psd"))


def label_spectra(t: Tables) -> DataFrame:
    """One log-mean spectrum per label, with its logarithm."""
    s = spectral.log_mean_spectrum(windows(t), ["label"])
    return s.withColumn("ls", spectral.log10_array(F.col("spectrum")))


@query(PSD_SQL + "SELECT vec_id, bin, round(power, 5) + 0.0 AS power FROM psd")
def hann_psd(t: Tables) -> DataFrame:
    out = windows(t).select("vec_id", F.posexplode("psd").alias("bin", "power"))
    return out.select("vec_id", "bin", (F.round("power", 5) + 0.0).alias("power"))


@query(PSD_SQL + "SELECT label, bin, round(ls, 6) + 0.0 AS log_power FROM lm")
def log_mean_spectrum(t: Tables) -> DataFrame:
    out = label_spectra(t).select("label", F.posexplode("ls").alias("bin", "v"))
    return out.select("label", "bin", r6("v").alias("log_power"))


@query(
    PSD_SQL + """, g AS (SELECT vec_id FROM embeddings WHERE list_max(embedding) - list_min(embedding) <= 0.6),
r AS (SELECT label, rec, bin, avg(log10(power)) AS m, count(*) AS n FROM psd JOIN g ON psd.vec_id = g.vec_id GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT label, bin, round(avg(m) + 0.5772156649015329 / ln(10), 6) + 0.0 AS log_power FROM r GROUP BY label, bin HAVING sum(n) >= 5
"""
)
def condition_spectrum(t: Tables) -> DataFrame:
    ptp = F.array_max("embedding") - F.array_min("embedding")
    x = F.transform(F.col("embedding"), lambda v: v.cast("double") * 100)
    kept = t.embeddings.filter(ptp <= F.lit(0.6)).select("label", (F.col("vec_id") % 4).alias("rec"), signal.psd(x, SFREQ).alias("psd"))
    s = spectral.condition_spectrum(kept, ["label"], "rec", min_record_windows=3)
    out = s.select("label", F.posexplode(spectral.log10_array(F.col("spectrum"))).alias("bin", "v"))
    return out.select("label", "bin", r6("v").alias("log_power"))


def _power(lo: int, hi: int) -> str:
    return f"sum(pow(10, ls)) FILTER (WHERE bin >= {lo} AND bin < {hi})"


@query(
    PSD_SQL + "SELECT label, " + ", ".join(
        f"round({_power(lo, hi)}, 5) AS {b}, round(log10({_power(lo, hi)} / {_power(4, 30)}), 6) AS rel_{b}" for b, lo, hi in (("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30))
    ) + ", round(log10(" + _power(13, 20) + " / " + _power(4, 20) + "), 6) AS rel20_lowbeta FROM lm GROUP BY label"
)
def band_power(t: Tables) -> DataFrame:
    s = F.col("spectrum")
    rel, rel20 = GRID.relative_logs(s), GRID.relative_logs(s, spectral.BANDS_20, spectral.TOTAL_BAND_20)
    return label_spectra(t).select(
        "label",
        *[F.round(GRID.integrals(s, [band])[0], 5).alias(b) for b, band in spectral.BANDS.items()],
        *[r6(c).alias(f"rel_{b}") for b, c in rel.items()],
        r6(rel20["lowbeta"]).alias("rel20_lowbeta"),
    )


FIT = "bin BETWEEN 3 AND 30 AND NOT bin BETWEEN 7 AND 14"


@query(
    PSD_SQL + f"SELECT label, round(-regr_slope(ls, log10(bin)) FILTER (WHERE {FIT}), 6) AS exponent, round(regr_intercept(ls, log10(bin)) FILTER (WHERE {FIT}), 6) AS intercept FROM lm WHERE bin > 0 GROUP BY label"
)
def aperiodic_slope(t: Tables) -> DataFrame:
    slope, intercept = GRID.line_fit(F.col("ls"), *spectral.BACKGROUND_FIT_HZ)
    return label_spectra(t).select("label", r6(-slope).alias("exponent"), r6(intercept).alias("intercept"))


# read as 128 Hz, bins are 2 Hz apart and every range lies below the Nyquist frequency
WIDE = spectral.Grid(N, 2 * SFREQ)
RANGES_SQL = ", ".join(f"('{n}', {lo}, {hi}, {e[0] if e else 99}, {e[1] if e else 99})" for n, (lo, hi, e) in spectral.SLOPE_RANGES.items())


@query(
    PSD_SQL + f""", rg(range, lo, hi, xlo, xhi) AS (VALUES {RANGES_SQL}),
k AS (SELECT range, label, log10(2 * bin) AS x, ls FROM lm JOIN rg ON 2 * bin BETWEEN lo AND hi AND NOT 2 * bin BETWEEN xlo AND xhi),
f AS (SELECT range, label, regr_slope(ls, x) AS b, regr_intercept(ls, x) AS a FROM k GROUP BY 1, 2)
SELECT k.range, k.label, round(-max(b), 6) + 0.0 AS exponent, round(sqrt(avg(pow(ls - (a + b * x), 2))), 6) AS rmse FROM k JOIN f ON k.range = f.range AND k.label = f.label GROUP BY 1, 2
"""
)
def slope_ranges(t: Tables) -> DataFrame:
    table, parts = label_spectra(t), []
    for i, (name, (lo, hi, exclude)) in enumerate(spectral.SLOPE_RANGES.items()):
        table = WIDE.with_slope_fit(table, "ls", f"fit{i}", lo, hi, exclude)
        parts.append(F.struct(F.lit(name).alias("range"), r6(f"fit{i}.exponent").alias("exponent"), r6(f"fit{i}.rmse").alias("rmse")))
    return table.select("label", F.explode(F.array(*parts)).alias("r")).select("r.range", "label", "r.exponent", "r.rmse")


@query(
    PSD_SQL + f""", v AS (SELECT vec_id, bin, log10(power) AS ls FROM psd),
f AS (SELECT vec_id, regr_slope(ls, log10(bin)) AS b, regr_intercept(ls, log10(bin)) AS a FROM v WHERE {FIT} GROUP BY vec_id),
r AS (SELECT v.vec_id, bin, ls - (a + b * log10(bin)) AS res FROM v JOIN f ON v.vec_id = f.vec_id WHERE bin BETWEEN 7 AND 13),
p AS (SELECT vec_id, max(res) AS h, arg_max(bin, res) AS top_bin FROM r GROUP BY vec_id)
SELECT p.vec_id, round(max(h), 5) + 0.0 AS height, CASE WHEN max(h) >= 0.3 THEN round(sum(bin * greatest(res, 0)) / sum(greatest(res, 0)), 5) END AS frequency
FROM p JOIN r ON p.vec_id = r.vec_id WHERE abs(bin - top_bin) <= 1 GROUP BY p.vec_id
"""
)
def alpha_peak(t: Tables) -> DataFrame:
    w = windows(t).select("vec_id", spectral.log10_array(F.col("psd")).alias("ls"))
    out = GRID.with_alpha_peak(w, "ls", "p")
    return out.select("vec_id", (F.round("p.height", 5) + 0.0).alias("height"), F.round("p.frequency", 5).alias("frequency"))


@query(
    PSD_SQL + "SELECT label, round(max(ls) FILTER (WHERE bin BETWEEN 8 AND 13) - 0.5 * (avg(ls) FILTER (WHERE bin BETWEEN 5 AND 7) + avg(ls) FILTER (WHERE bin BETWEEN 14 AND 17)), 6) AS prominence FROM lm GROUP BY label"
)
def prominence(t: Tables) -> DataFrame:
    return label_spectra(t).select("label", r6(GRID.prominence(F.col("spectrum"))).alias("prominence"))


@query(
    PSD_SQL + "SELECT bin, round(quantile_cont(log10(power), 0.25), 6) + 0.0 AS q25, round(quantile_cont(log10(power), 0.5), 6) + 0.0 AS q50, round(quantile_cont(log10(power), 0.75), 6) + 0.0 AS q75 FROM psd GROUP BY bin"
)
def quantile_curves(t: Tables) -> DataFrame:
    """Median and quartile curve of the log spectrum."""
    rows = windows(t).select(F.posexplode("psd").alias("bin", "power")).select("bin", F.log10("power").alias("v"))
    out = ordered.quantiles(rows, ["bin"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return out.select("bin", *[r6(c).alias(c) for c in ("q25", "q50", "q75")])
