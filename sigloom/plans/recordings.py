"""Recording queries: embeddings become EDF files inside Spark, and the recording pipeline reads them back.

Up to 125 consecutive vectors form one six-channel recording of 8,000 samples at 125 Hz, so the number of
recordings grows with the table and the size of one does not. A shorter last one is filled with zeros to whole seconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import recordings, windows
from sigloom.operators.windows import Reject
from sigloom.plans.registry import Tables, query, r6
from sigloom.sources import edf

PER_FILE = 125
FILES_PER_TASK = 32

DIGITAL_SQL = f"""
WITH c(channel, shift, sign) AS (VALUES ('O1', 0, 1), ('T3', 7, 1), ('Fp1', 14, 1), ('Fp2', 21, -1), ('T4', 28, 1), ('O2', 0, 1)),
v AS (SELECT vec_id, vec_id // {PER_FILE} AS rec, CAST(round_even(CAST(embedding[i + 1] AS DOUBLE) * 4096, 0) AS INTEGER) AS d, (vec_id % {PER_FILE}) * 64 + i AS pos FROM embeddings CROSS JOIN range(0, 64) r(i)),
own AS (SELECT rec, count(*) AS len FROM v GROUP BY rec), n AS (SELECT rec, len AS given, (len + 124) // 125 * 125 AS len FROM own),
p AS (SELECT rec, d, pos FROM v UNION ALL SELECT rec, 0, unnest(range(given, len)) FROM n),
raw AS (SELECT p.rec, c.channel, (p.pos + c.shift) % n.len AS t, c.sign * p.d AS d, n.len AS used FROM p JOIN n ON p.rec = n.rec CROSS JOIN c),
s AS (SELECT * FROM raw WHERE t < used)
"""


def files(t: Tables) -> DataFrame:
    """One EDF file per 125 vectors, as (path, file_bytes, content)."""
    # the number is given, so that a task packs a few files whatever the size of the table
    parts = max(1, -(-t.embeddings.count() // (PER_FILE * FILES_PER_TASK)))
    rows = t.embeddings.withColumn("rec", F.floor(F.col("vec_id") / PER_FILE)).repartition(parts, "rec")
    packed = rows.groupBy("rec").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("rows")
    )

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            flat = np.round(np.concatenate([np.asarray(v, dtype=float) for v in r]) * 4096)
            flat = np.pad(flat, (0, -len(flat) % 125))
            out.append(edf.encode(np.stack([np.roll(flat, k) * s for k, s in ((0, 1), (7, 1), (14, 1), (21, -1), (28, 1), (0, 1))]), edf.CHANNELS, 125, -800.0, 800.0))
        return pd.Series(out)

    content = packed.select(F.concat(F.lit("rec-"), F.col("rec").cast("string")).alias("path"), encode("rows").alias("content"))
    return content.select("path", F.length("content").cast("long").alias("file_bytes"), "content")


@query(
    DIGITAL_SQL + "SELECT 'rec-' || rec AS path, channel, CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS total, CAST(sum(d * (t % 1000)) AS BIGINT) AS moment, "
    "CAST(min(d) AS INTEGER) AS lo, CAST(max(d) AS INTEGER) AS hi FROM s GROUP BY rec, channel"
)
def edf_decode(t: Tables) -> DataFrame:
    """Decoded samples, checked by sums and a position-weighted moment."""
    s = edf.samples(files(t), per_piece=1000).select("path", "channel", "start", F.posexplode("digital").alias("i", "d"))
    pos = F.col("start") + F.col("i")
    return s.groupBy("path", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"), F.sum(F.col("d") * (pos % 1000)).alias("moment"), F.min("d").cast("int").alias("lo"), F.max("d").cast("int").alias("hi")
    )


@query(
    DIGITAL_SQL + "SELECT 'rec-' || rec AS path, 'ok' AS status, CAST(125 AS DOUBLE) AS sfreq, CAST(max(used) AS BIGINT) AS n_times, max(used) / CAST(125 AS DOUBLE) AS duration_s, "
    "CAST(256 * 7 + max(used) * 12 AS BIGINT) AS file_bytes, round(CAST(1600 AS DOUBLE) / 65535, 6) AS quant_step_uv FROM s GROUP BY rec"
)
def edf_headers(t: Tables) -> DataFrame:
    h = edf.headers(files(t))
    return h.select("path", "status", "sfreq", "n_times", "duration_s", "file_bytes", r6("quant_step_uv").alias("quant_step_uv"))


@query(DIGITAL_SQL + "SELECT DISTINCT 'rec-' || rec AS path, channel FROM s WHERE channel IN ('O1', 'O2')")
def copied_channels(t: Tables) -> DataFrame:
    """O2 repeats O1 in every file."""
    return edf.copied_channels(edf.channel_digests(files(t), per_piece=1000))


@query(
    DIGITAL_SQL + """, w AS (SELECT s.rec, s.channel, k, (CAST(1600 AS DOUBLE) / 65535) * d + (-800 + (CAST(1600 AS DOUBLE) / 65535) * 32768) AS uv, t - k * 500 AS x
  FROM s CROSS JOIN range(0, 17) q(k) WHERE t >= k * 500 AND t < k * 500 + 500 AND (k + 1) * 500 <= used),
f AS (SELECT rec, channel, k, regr_slope(uv, x) AS b, regr_intercept(uv, x) AS a FROM w GROUP BY 1, 2, 3)
SELECT 'rec-' || w.rec AS path, w.channel, CAST(w.k AS BIGINT) AS window_idx, round(stddev_pop(uv - (a + b * x)), 5) AS sd, round(max(uv - (a + b * x)) - min(uv - (a + b * x)), 5) AS ptp
FROM w JOIN f ON w.rec = f.rec AND w.channel = f.channel AND w.k = f.k GROUP BY 1, 2, 3
"""
)
def edf_windows(t: Tables) -> DataFrame:
    """Detrended 4-s windows, unfiltered so that SQL can follow."""
    plain = recordings.Conditioning(band_hz=(None, None), frame_s=(4.0, 4.0))
    w = recordings.conditioned_windows(files(t), plain, per_piece=2)
    return w.select("path", "channel", "window_idx", F.round("sd", 5).alias("sd"), F.round("ptp", 5).alias("ptp"))


GAIN_UV = "(CAST(1600 AS DOUBLE) / 65535)"


def _listed(values: np.ndarray) -> str:
    return "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values) + "]"


UV = f"{GAIN_UV} * d + (-800 + {GAIN_UV} * 32768)"


def _convolved(taps: np.ndarray, step: int = 1) -> str:
    """SQL: sums of taps and the padded samples px(rec, channel, n, pos, v), read at every ``step``-th place."""
    return f"""taps AS (SELECT unnest({_listed(taps)}) AS tap, unnest(range(0, {taps.size})) AS j),
cv AS (SELECT rec, channel, (pos - j) // {step} AS t, sum(v * tap) AS v FROM px CROSS JOIN taps WHERE pos - j >= 0 AND pos - j < n AND (pos - j) % {step} = 0 GROUP BY 1, 2, 3)"""


def filtered_sql(low: float | None, high: float | None) -> str:
    """CTEs up to y(rec, channel, t, v): the zero-phase filtered signal; the ends go on by odd reflection."""
    taps = signal.fir_taps(125.0, low, high)
    half = taps.size // 2
    return DIGITAL_SQL + f""", xs AS (SELECT rec, channel, t, {UV} AS v, used AS n FROM s),
e AS (SELECT rec, channel, arg_min(v, t) AS first, arg_max(v, t) AS last FROM xs GROUP BY 1, 2),
px AS (SELECT rec, channel, n, t + {half} AS pos, v FROM xs UNION ALL SELECT x.rec, x.channel, n, {half} - t, 2 * first - v FROM xs x JOIN e ON x.rec = e.rec AND x.channel = e.channel WHERE t BETWEEN 1 AND {half}
  UNION ALL SELECT x.rec, x.channel, n, {half} + 2 * (n - 1) - t, 2 * last - v FROM xs x JOIN e ON x.rec = e.rec AND x.channel = e.channel WHERE t BETWEEN n - 1 - {half} AND n - 2),
{_convolved(taps)}, y AS (SELECT * FROM cv)"""


def resampled_sql(target: float) -> str:
    """CTEs up to y(rec, channel, t, v): every so many samples after the anti-alias filter, around the line from first to last sample."""
    up, down = signal.resample_ratio(125.0, target)
    assert up == 1
    taps = signal.resample_taps(up, down)
    return DIGITAL_SQL + f""", xs AS (SELECT rec, channel, t, {UV} AS v, used AS n FROM s),
e AS (SELECT rec, channel, arg_min(v, t) AS first, (arg_max(v, t) - arg_min(v, t)) / (count(*) - 1) AS slope FROM xs GROUP BY 1, 2),
px AS (SELECT x.rec, x.channel, n, t + {taps.size // 2} AS pos, v - (first + slope * t) AS v FROM xs x JOIN e ON x.rec = e.rec AND x.channel = e.channel),
{_convolved(taps, down)}, y AS (SELECT c.rec, c.channel, t, v + first + slope * t * {down} AS v FROM cv c JOIN e ON c.rec = e.rec AND c.channel = e.channel)"""


def windowed_sql(width: int, step: int) -> str:
    """CTE q(rec, channel, k, sd, ptp, lv) behind y: statistics of detrended windows."""
    return f""", z AS (SELECT rec, max(t) + 1 AS size FROM y GROUP BY rec),
cut AS (SELECT y.rec, channel, k, v, t - k * {step} AS i FROM (SELECT y.*, size, unnest(range(greatest(0, (t - {width} + {step}) // {step}), t // {step} + 1)) AS k FROM y JOIN z ON z.rec = y.rec) y WHERE k * {step} + {width} <= size AND t >= k * {step} AND t < k * {step} + {width}),
fit AS (SELECT rec, channel, k, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM cut GROUP BY 1, 2, 3),
q AS (SELECT c.rec, c.channel, c.k, stddev_pop(v - (a + b * i)) AS sd, max(v - (a + b * i)) - min(v - (a + b * i)) AS ptp, round(ln(var_pop(v - (a + b * i)) + {recordings.TINY!r}), 12) AS lv
  FROM cut c JOIN fit f ON c.rec = f.rec AND c.channel = f.channel AND c.k = f.k GROUP BY 1, 2, 3)"""


WINDOW_ROWS = " SELECT 'rec-' || rec AS path, channel, CAST(k AS BIGINT) AS window_idx, round(sd, 5) AS sd, round(ptp, 5) AS ptp FROM q"


def _stats(t: Tables, cfg: recordings.Conditioning) -> DataFrame:
    w = recordings.conditioned_windows(files(t), cfg, per_piece=3, values=False)
    return w.select("path", "channel", "window_idx", F.round("sd", 5).alias("sd"), F.round("ptp", 5).alias("ptp"))


@query(filtered_sql(None, 40.0) + windowed_sql(500, 250) + WINDOW_ROWS)
def edf_lowpass(t: Tables) -> DataFrame:
    """Windows of the standard conditioning: low-pass, half overlapping, detrended."""
    return _stats(t, recordings.Conditioning())


@query(filtered_sql(2.0, 20.0) + windowed_sql(500, 500) + WINDOW_ROWS)
def edf_bandpass(t: Tables) -> DataFrame:
    """Windows of the band-passed signal."""
    return _stats(t, recordings.Conditioning(band_hz=(2.0, 20.0), frame_s=(4.0, 4.0)))


@query(resampled_sql(62.5) + windowed_sql(250, 250) + WINDOW_ROWS)
def edf_resampled(t: Tables) -> DataFrame:
    """Windows of the signal at half the rate."""
    return _stats(t, recordings.Conditioning(rate_hz=62.5, band_hz=(None, None), frame_s=(4.0, 4.0)))


LIMITS = recordings.Limits()


# CTE f(rec, channel, k, reject) behind q: the reject bits of the standard limits
FLAGS_SQL = f""", a AS (SELECT *, CASE WHEN sd < {LIMITS.flat_uv} THEN 1 ELSE 0 END + CASE WHEN ptp > {LIMITS.range_uv} THEN 4 ELSE 0 END AS f0 FROM q),
m AS (SELECT rec, channel, quantile_cont(lv, 0.5) AS med, count(*) AS ref FROM a WHERE f0 = 0 GROUP BY 1, 2),
mad AS (SELECT a.rec, a.channel, quantile_cont(abs(lv - med), 0.5) AS mad FROM a JOIN m ON a.rec = m.rec AND a.channel = m.channel WHERE f0 = 0 GROUP BY 1, 2),
f AS (SELECT a.*, f0 + CASE WHEN ref >= {LIMITS.outlier_windows} AND mad > 0 AND (lv - med) / (1.4826 * mad) > {LIMITS.outlier_z} THEN 8 ELSE 0 END + CASE WHEN a.channel IN ('O1', 'O2') THEN 32 ELSE 0 END AS reject
  FROM a LEFT JOIN m ON a.rec = m.rec AND a.channel = m.channel LEFT JOIN mad ON a.rec = mad.rec AND a.channel = mad.channel)"""


@query(
    filtered_sql(None, 40.0) + windowed_sql(500, 250) + FLAGS_SQL + """
SELECT 'rec-' || rec AS path, channel, CAST(count(*) AS BIGINT) AS n_windows, CAST(count(*) FILTER (WHERE reject = 0) AS BIGINT) AS n_good, """
    + ", ".join(f"round(avg(CASE WHEN reject & {int(r)} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS frac_{r.name.lower()}" for r in Reject)
    + " FROM f GROUP BY rec, channel"
)
def edf_quality(t: Tables) -> DataFrame:
    """Share of windows per rejection reason, per file and channel."""
    w = recordings.flagged_windows(files(t), values=False)
    out = windows.quality_table(w, ["path", "channel"])
    return out.select("path", "channel", "n_windows", "n_good", *[r6(f"frac_{r.name.lower()}").alias(f"frac_{r.name.lower()}") for r in Reject])
