"""Averaged responses: an ERP table has one row per (subject, bin, channel) with ``t0_s``, ``sfreq`` and samples ``x``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators.cycles import mean_arrays
from sigloom.sources import edf

# Fixed values
SITES = {"O1": "O1", "T3": "C5", "Fp1": "FP1", "Fp2": "FP2", "T4": "C6", "O2": "O2"}
DEVIANT, STANDARD = "Deviants", "Standards, Preceded by a Standard"
HIGHPASS_HZ = 2.0
MMN_WINDOW_S = (0.125, 0.225)
VIEWS: tuple[tuple[str, tuple[str, ...], int], ...] = (
    ("FCz", ("FCz",), 0), ("Fp", ("FP1", "FP2"), 0), ("Fp HP1", ("FP1", "FP2"), 1), ("Fp HP2", ("FP1", "FP2"), 2),
    ("Fp HP4", ("FP1", "FP2"), 4), ("C5/C6 HP4", ("C5", "C6"), 4), ("O1/O2 HP4", ("O1", "O2"), 4),
)


def causal_highpass(x: Column, sfreq: Column, order: int, cutoff_hz: float = HIGHPASS_HZ) -> Column:
    """Causal Butterworth high-pass of an array column, starting from rest."""
    if order == 0:
        return x

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([signal.butter_highpass(np.asarray(v, dtype=float), float(r), order, cutoff_hz) for v, r in zip(values, rate)])

    return run(x, sfreq)


def resampled(x: np.ndarray, sfreq: float, target: float = edf.TARGET_SFREQ) -> np.ndarray:
    """Rational resampling along the last axis; the line from first to last sample is set aside while filtering."""
    up, down = signal.resample_ratio(sfreq, target)
    if up == down:
        return np.array(x, dtype=float)
    taps, n = signal.resample_taps(up, down), x.shape[-1]
    line = lambda t: x[..., :1] + (x[..., -1:] - x[..., :1]) * (t / (n - 1))
    wide = np.zeros((*x.shape[:-1], n * up))
    wide[..., ::up] = x - line(np.arange(n))
    full = np.apply_along_axis(np.convolve, -1, wide, taps)[..., taps.size // 2 :]
    at = np.arange(-(-n * up // down)) * down
    return full[..., at] + line(at / up)


def site_average(erps: DataFrame, sites: Sequence[str], order: int) -> DataFrame:
    """Waves of each subject as the mean of the chosen channels, passed through the causal filter; one row a subject."""
    kept = erps.filter(F.col("channel").isin(*sites) & F.col("bin").isin(DEVIANT, STANDARD))
    meta = kept.groupBy("subject").agg(F.max("t0_s").alias("t0_s"), F.max("sfreq").alias("sfreq"))
    means = mean_arrays(kept.select("subject", F.col("bin").alias("condition"), "x"), ["subject", "condition"], "x", "wave")
    means = means.join(meta, "subject").withColumn("wave", causal_highpass(F.col("wave"), F.col("sfreq"), order))
    pick = lambda b: F.max(F.when(F.col("condition") == b, F.col("wave")))
    wide = means.groupBy("subject", "t0_s", "sfreq").agg(pick(DEVIANT).alias("deviant"), pick(STANDARD).alias("standard"))
    return wide.withColumn("difference", F.zip_with("deviant", "standard", lambda a, b: a - b))


def view(erps: DataFrame, order: int) -> DataFrame:
    """The six target channels from their nearest sites, after the emulated high-pass."""
    names = F.create_map(*[F.lit(v) for target, site in SITES.items() for v in (site, target)])
    kept = erps.filter(F.col("channel").isin(*SITES.values())).withColumn("channel", F.element_at(names, F.col("channel")))
    return kept.withColumn("x", causal_highpass(F.col("x"), F.col("sfreq"), order))


def curves(waves: DataFrame) -> DataFrame:
    """Mean and standard error over subjects per (wave, time)."""
    long = waves.select("subject", "t0_s", "sfreq", F.explode(F.array(*[F.struct(F.lit(w).alias("wave"), F.col(w).alias("x")) for w in ("deviant", "standard", "difference")])).alias("w"))
    cells = long.select("subject", "t0_s", "sfreq", "w.wave", F.posexplode("w.x").alias("i", "v"))
    time = F.round(F.col("t0_s") + F.col("i") / F.col("sfreq"), 9)
    return cells.groupBy("wave", time.alias("time_s")).agg(F.avg("v").alias("mean_uv"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem_uv"))


def summary(erps: DataFrame, views: Sequence[tuple[str, tuple[str, ...], int]] = VIEWS) -> DataFrame:
    """One row of response measures per view."""
    out = None
    t = F.col("time_s")
    for label, sites, order in views:
        waves = site_average(erps, sites, order)
        cells = waves.select("subject", "t0_s", "sfreq", F.posexplode("difference").alias("i", "v"))
        inside = (F.col("t0_s") + F.col("i") / F.col("sfreq")).between(*MMN_WINDOW_S)
        mmn = cells.filter(inside).groupBy("subject").agg(F.avg("v").alias("m"))
        one = mmn.agg(
            F.round(F.avg("m"), 3).alias("mmn_window_mean_uv"), F.round(F.stddev_samp("m"), 3).alias("mmn_window_sd_uv"),
            F.round(F.avg((F.col("m") < 0).cast("double")), 3).alias("mmn_window_share_negative"),
        )
        c, y = curves(waves), F.col("mean_uv")
        diff, std = F.col("wave") == "difference", F.col("wave") == "standard"
        extreme = F.max_by(F.struct("mean_uv", "time_s"), F.when(diff & t.between(0.05, 0.40), F.struct(F.abs(y), -t)))
        lowest = F.min_by(F.struct("mean_uv", "time_s"), F.when(std & t.between(0.05, 0.20), F.struct(y, t)))
        two = c.agg(extreme.alias("e"), lowest.alias("l"), F.sqrt(F.avg(F.when(diff & t.between(0.0, 0.6), y * y))).alias("rms"))
        two = two.select(
            F.round("e.mean_uv", 3).alias("difference_extremum_uv"), F.round("e.time_s", 4).alias("difference_extremum_latency_s"),
            F.round("rms", 3).alias("difference_rms_0_600ms_uv"), F.round("l.mean_uv", 3).alias("standard_n1_uv"), F.round("l.time_s", 4).alias("standard_n1_latency_s"),
        )
        row = one.crossJoin(two).withColumn("view", F.lit(label))  # two one-row tables
        out = row if out is None else out.unionByName(row)
    return out
