"""Condition report beyond the frontal group: curves of every channel with their error, and the topography with its random control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import arrays, cycles

# Fixed value
CHANNEL_SURROGATES = 500


def channel_halves(halves: DataFrame, min_cycles: int = cycles.MIN_CYCLES_PER_HALF) -> DataFrame:
    """One row per (path, channel) with enough cycles in both halves: their spectra as arrays."""
    side = lambda h, part: F.max(F.when(F.col("half") == h, F.col(part))).alias(f"{part}{h}")
    wide = halves.groupBy("path", "channel").agg(F.min("n_cycles").alias("_c"), F.count(F.lit(1)).alias("_n"), *[side(h, part) for h in (0, 1) for part in ("re", "im")])
    return wide.filter((F.col("_n") == 2) & (F.col("_c") >= min_cycles)).drop("_n", "_c")


def aligned_curves(halves: DataFrame, measures: DataFrame, band: tuple[float, float] = cycles.BAND_HZ) -> DataFrame:
    """Curves of every valid (record, channel): each half read at the landmarks that the other half of the record found."""
    marks = [f"{k}_s" for k in ("onset_a", "onset_b", "tau_a", "tau_b")]
    rows = channel_halves(halves).join(measures.select("path", "subject", *marks), "path")
    epoch = np.arange(*cycles.EPOCH)
    sets = {"deviant": (cycles.offbeat(band), "tau", cycles.GAIN), "grid": (cycles.harmonics(cycles.GRID_HZ), "onset", 1.0)}

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks:
            if not len(pdf):
                continue
            first, second = cycles._block(pdf)
            at = {k: np.round(pdf[f"{k}_s"].to_numpy(float) * cycles.FINE_HZ).astype(int) for k in ("onset_a", "onset_b", "tau_a", "tau_b")}
            for kind, (bins, mark, gain) in sets.items():
                curve = 0.5 * gain * (cycles.Series(second, bins).values(epoch, at[f"{mark}_a"]) + cycles.Series(first, bins).values(epoch, at[f"{mark}_b"]))
                yield pd.DataFrame({"path": pdf["path"], "subject": pdf["subject"], "channel": pdf["channel"], "kind": kind, "curve": list(curve)})

    return rows.mapInPandas(run, "path string, subject string, channel string, kind string, curve array<double>")


def group_curves(curves: DataFrame) -> DataFrame:
    """Mean and standard error over subjects per (kind, channel, time); records are averaged within their subject first."""
    per = arrays.mean_sem(curves, ["kind", "channel", "subject"], "curve").select("kind", "channel", F.col("mean").alias("curve"))
    every = arrays.mean_sem(per, ["kind", "channel"], "curve")
    cells = every.select("kind", "channel", "sem", F.posexplode("mean").alias("i", "mean_uv"))
    time = F.round(F.lit(cycles.EPOCH[0] / cycles.FINE_HZ) + F.col("i") / cycles.FINE_HZ, 9)
    return cells.select("kind", "channel", time.alias("time_s"), "mean_uv", F.get("sem", F.col("i")).alias("sem_uv"))


def topography(halves: DataFrame, records: DataFrame, n_surrogates: int = CHANNEL_SURROGATES, seed: int = 42, band: tuple[float, float] = cycles.BAND_HZ) -> DataFrame:
    """Half correlations of every channel as group means, with the share of random delays that reach them.

    ``records`` names the valid ``path`` and ``subject``; all channels of a record get the same delay. A row carries the observed value
    and those of all surrogates as one array, so subject and group means are element-wise.
    """
    rows = channel_halves(halves).join(records.select("path", "subject", cycles.delay_base(seed + 1).alias("_base")), "path")
    sets = {"grid_r": cycles.harmonics(cycles.GRID_HZ), "deviant_r": cycles.offbeat(band)}

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks:
            if not len(pdf):
                continue
            first, second = cycles._block(pdf)
            delays = np.column_stack([np.zeros(len(pdf), int), cycles.random_delays(pdf["_base"].to_numpy(), np.arange(n_surrogates))])
            for name, bins in sets.items():
                one, two = cycles.Series(first, bins), cycles.Series(second, bins)
                r = np.stack([one.agreement(two, delays[:, s]) for s in range(delays.shape[1])], axis=1)
                yield pd.DataFrame({"channel": pdf["channel"], "statistic": name, "subject": pdf["subject"], "r": list(r)})

    found = rows.mapInPandas(run, "channel string, statistic string, subject string, r array<double>")
    per = arrays.mean_sem(found, ["channel", "statistic", "subject"], "r")
    every = arrays.mean_sem(per.select("channel", "statistic", F.col("mean").alias("r")), ["channel", "statistic"], "r")
    n = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n_records"))
    null = F.slice("mean", 2, n_surrogates)
    at_least = F.size(F.filter(null, lambda v: v >= F.get("mean", F.lit(0))))
    return every.join(n, "channel").select("channel", "statistic", "n_records", F.get("mean", F.lit(0)).alias("observed"), ((1 + at_least) / (1 + F.size(null))).alias("p"))
