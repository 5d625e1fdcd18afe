"""Plausibility studies: slope robustness, RMS ratios, slow spectra, filter order, detection shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import arrays, erp, features, ordered, recordings, spectral
from sigloom.session import checkpointed

LOWFREQ = recordings.Conditioning(band_hz=(None, None), frame_s=(16.0, 8.0), detrend=False)


def slope_robustness(power: DataFrame, keys: Sequence[str] = ("path", "channel")) -> DataFrame:
    """Exponent and fit error under four frequency ranges, per record and channel."""
    s = spectral.condition_spectrum(power.withColumn("_r", F.lit(0)), list(keys), "_r").withColumn("ls", spectral.log10_array(F.col("spectrum")))
    fits = []
    for i, (name, (lo, hi, exclude)) in enumerate(spectral.SLOPE_RANGES.items()):
        s = features.GRID.with_slope_fit(s, "ls", f"fit{i}", lo, hi, exclude)
        fits.append(F.struct(F.lit(name).alias("range"), F.col(f"fit{i}.exponent").alias("exponent"), F.col(f"fit{i}.rmse").alias("rmse")))
    return s.select(*keys, F.explode(F.array(*fits)).alias("f")).select(*keys, "f.*")


def rms_ratio(flagged: DataFrame, channel: str, key: str = "path") -> DataFrame:
    """RMS of one channel over the median RMS of the others, from median window variances."""
    mid = ordered.median(flagged.filter("reject = 0").withColumn("v", F.col("sd") * F.col("sd")), [key, "channel"], "v", "v")
    rms = mid.withColumn("rms", F.sqrt("v"))
    own = rms.filter(F.col("channel") == channel).select(key, F.col("rms").alias("own"))
    others = ordered.median(rms.filter(F.col("channel") != channel), [key], "rms", "others")
    return own.join(others, key).select(key, (F.col("own") / F.col("others")).alias("ratio"))


def lowfreq_spectrum(files: DataFrame, channels: Sequence[str] = ("Fp1", "Fp2")) -> DataFrame:
    """Median-averaged spectrum of 16-s half-overlapping segments, averaged over two channels: (path, freq, psd)."""
    w = recordings.conditioned_windows(files, LOWFREQ, per_piece=30).filter(F.col("channel").isin(*channels))
    spectra = checkpointed(w.select("path", "channel", signal.psd(F.col("x"), LOWFREQ.rate_hz, centred=True).alias("psd")))
    sizes = spectra.groupBy("path", "channel").agg(F.count(F.lit(1)).alias("n"))
    half = F.floor((F.col("n") - 1) / 2).cast("int")
    # bias of the median of n exponential variables
    bias = F.when(half < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), F.lit(1.0), lambda a, i: a + 1 / (2 * i + 1) - 1 / (2 * i)))
    mid = arrays.median(spectra, ["path", "channel"], "psd").join(sizes.select("path", "channel", bias.alias("bias")), ["path", "channel"])
    cells = mid.select("path", "bias", F.posexplode("median").alias("bin", "v"))
    return cells.groupBy("path", (F.col("bin") / LOWFREQ.frame_s[0]).alias("freq")).agg(F.avg(F.col("v") / F.col("bias")).alias("psd"))


def summarize_power(replicates: DataFrame, nulls: DataFrame, microvolts_per_unit: float) -> DataFrame:
    """Detection shares and recovery accuracy per (variant, amplitude)."""
    m = replicates.join(nulls, ["amplitude", "variant"])
    hit = lambda s: F.avg((F.col(s) > F.col(f"{s}_q95")).cast("double"))
    means = ("deviant_r", "grid_r", "deviant_found", "phase_within_50ms", "phase_within_50ms_of_bias", "phase_bias_s", "n_records")
    out = m.groupBy("variant", "amplitude").agg(hit("deviant_r").alias("test2_power"), hit("curve_energy").alias("test3_power"), *[F.avg(c).alias(c) for c in means])
    return out.withColumn("difference_rms_uv", F.col("amplitude") * F.lit(float(microvolts_per_unit)))


def highpass_order_fit(spectrum: DataFrame, keys: Sequence[str] = (), orders: Sequence[int] = (1, 2, 3, 4), band: tuple[float, float] = (0.3, 6.5), cutoff: float = erp.HIGHPASS_HZ) -> DataFrame:
    """Fit of c - chi * log10 f + log10 |H_n(f)|^2 per order n to rows (keys, freq, log10_psd)."""
    kept = spectrum.filter(F.col("freq").between(*band)).select(*keys, "freq", "log10_psd", F.explode(F.array(*map(F.lit, orders))).alias("order"))
    ratio = F.pow(F.col("freq") / F.lit(cutoff), 2 * F.col("order"))
    y, x = F.col("log10_psd") - F.log10(ratio / (1 + ratio)), F.log10("freq")
    rows = kept.select(*keys, "order", y.alias("y"), x.alias("x"))
    fit = rows.groupBy(*keys, "order").agg(
        F.regr_intercept("y", "x").alias("c"), (-F.regr_slope("y", "x")).alias("chi"),
        (F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("ssr"),
    )
    return fit
