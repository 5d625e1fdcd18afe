"""Spectra and spectral features.

Windows become one power array per row; pooling works on (key, bin) rows with map-side partial sums; the
pooled spectrum of a key is a short array again, and every feature of it is a plain column expression.
On a fixed frequency grid a least-squares line is a fixed weighted sum, so fits need no UDF either.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
EULER_GAMMA = 0.5772156649015329
LOG10_BIAS = EULER_GAMMA / math.log(10.0)
MIN_GOOD_WINDOWS = 5
MIN_TRIAL_WINDOWS = 3
BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
TOTAL_BAND = (4.0, 30.0)
BANDS_20 = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "lowbeta": (13.0, 20.0)}
TOTAL_BAND_20 = (4.0, 20.0)
BACKGROUND_FIT_HZ = (3.0, 30.0)
BACKGROUND_FIT_20_HZ = (3.0, 20.0)
BACKGROUND_EXCLUDE_HZ = (7.0, 14.0)
ALPHA_SEARCH_HZ = (7.0, 13.0)
MIN_PEAK_LOG10 = 0.3
CENTROID_HALF_WIDTH_HZ = 1.0
SLOPE_RANGES: dict[str, tuple[float, float, tuple[float, float] | None]] = {
    "3-30 w/o 7-14": (3.0, 30.0, (7.0, 14.0)),
    "4-25 w/o 7-14": (4.0, 25.0, (7.0, 14.0)),
    "14-30": (14.0, 30.0, None),
    "20-35": (20.0, 35.0, None),
}


def log_mean_bins(windows: DataFrame, keys: Sequence[str], psd: str, carry: Sequence[Column] = ()) -> DataFrame:
    """Mean log10 power per (keys, bin) with the number of windows."""
    bins = windows.select(*keys, *carry, F.posexplode(psd).alias("bin", "power"))
    return bins.groupBy(*keys, "bin").agg(F.avg(F.log10("power")).alias("mean_log"), F.count(F.lit(1)).alias("n_windows"))


def as_array(bins: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Bins of a key back to one array, in bin order."""
    packed = F.array_sort(F.collect_list(F.struct("bin", value.alias("v"))))
    return bins.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(name))


def log_mean_spectrum(windows: DataFrame, keys: Sequence[str], psd: str = "psd", name: str = "spectrum") -> DataFrame:
    """Bias-corrected geometric mean spectrum per key."""
    return as_array(log_mean_bins(windows, keys, psd), keys, F.pow(F.lit(10.0), F.col("mean_log") + LOG10_BIAS), name)


def condition_spectrum(
    windows: DataFrame,
    keys: Sequence[str],
    record: str,
    psd: str = "psd",
    min_windows: int = MIN_GOOD_WINDOWS,
    min_record_windows: int | Column = 1,
    name: str = "spectrum",
) -> DataFrame:
    """Pooled spectrum per key from usable windows: log-mean per record, then records with equal weight.

    Records with too few windows are ignored; a key with too few windows in all is absent.
    """
    per_record = log_mean_bins(windows, [*keys, record], psd).filter(F.col("n_windows") >= min_record_windows)
    pooled = per_record.groupBy(*keys, "bin").agg(F.avg("mean_log").alias("mean_log"), F.sum("n_windows").alias("n_windows"))
    enough = pooled.filter(F.col("n_windows") >= min_windows)
    return as_array(enough, keys, F.pow(F.lit(10.0), F.col("mean_log") + LOG10_BIAS), name)


class Grid:
    """Frequencies of a power array and the column expressions that depend on them."""

    def __init__(self, n_samples: int, sfreq: float) -> None:
        self.freqs = np.fft.rfftfreq(n_samples, 1 / sfreq)
        self.step = float(self.freqs[1])

    def _between(self, lo: float, hi: float, closed: bool) -> np.ndarray:
        f = self.freqs
        return np.flatnonzero((f >= lo) & ((f <= hi) if closed else (f < hi)))

    @staticmethod
    def _pick(arr: Column, idx: np.ndarray) -> Column:
        if idx.size and np.array_equal(idx, np.arange(idx[0], idx[-1] + 1)):
            return F.slice(arr, int(idx[0]) + 1, int(idx.size))
        return F.concat(*[F.slice(arr, int(g[0]) + 1, int(g.size)) for g in np.split(idx, np.flatnonzero(np.diff(idx) > 1) + 1)])

    @staticmethod
    def _sum(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)

    @staticmethod
    def _dot(arr: Column, weights: np.ndarray) -> Column:
        w = F.array(*[F.lit(float(x)) for x in weights])
        return F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def _share(self, lo: float, hi: float) -> np.ndarray:
        """Integration weight of every bin for [lo, hi)."""
        return np.where((self.freqs >= lo) & (self.freqs < hi), self.step, 0.0)

    def integrals(self, spectrum: Column, spans: Sequence[tuple[float, float]]) -> list[Column]:
        """Power in each span, as products of the spectrum with one row of a weight matrix."""
        weights = [self._share(*span) for span in spans]
        used = [np.flatnonzero(w) for w in weights]
        return [self._dot(self._pick(spectrum, at), w[at]) if at.size else F.lit(0.0) for at, w in zip(used, weights)]

    def relative_logs(self, spectrum: Column, bands: Mapping[str, tuple[float, float]] = BANDS, whole: tuple[float, float] = TOTAL_BAND) -> dict[str, Column]:
        """log10 of each band's part of ``whole``."""
        *parts, total = self.integrals(spectrum, [*bands.values(), whole])
        return {name: F.log10(part) - F.log10(total) for name, part in zip(bands, parts)}

    def _fit_index(self, lo: float, hi: float, exclude: tuple[float, float] | None) -> np.ndarray:
        idx = self._between(lo, hi, closed=True)
        return idx if exclude is None else np.setdiff1d(idx, self._between(*exclude, closed=True))

    def line_fit(
        self, log_spectrum: Column, lo: float, hi: float, exclude: tuple[float, float] | None = BACKGROUND_EXCLUDE_HZ
    ) -> tuple[Column, Column]:
        """Slope and intercept of log10 power on log10 frequency; NULL when the range has gaps."""
        idx = self._fit_index(lo, hi, exclude)
        x = np.log10(self.freqs[idx])
        dx = (x - x.mean()) / ((x - x.mean()) @ (x - x.mean()))
        part = self._pick(log_spectrum, idx)
        return self._dot(part, dx), self._dot(part, 1.0 / idx.size - x.mean() * dx)

    def exponent(self, log_spectrum: Column, fit: tuple[float, float] = BACKGROUND_FIT_HZ) -> Column:
        return -self.line_fit(log_spectrum, *fit)[0]

    def _residuals(self, df: DataFrame, log_spectrum: str, idx: np.ndarray, fit: tuple[float, float], exclude: tuple[float, float] | None) -> DataFrame:
        """Add ``_fit`` (slope b, intercept a) and ``_res``: (frequency, distance from the line) at ``idx``.

        Intermediate columns keep the fit from being evaluated again for every array element.
        """
        b, a = self.line_fit(F.col(log_spectrum), *fit, exclude)
        df = df.withColumn("_fit", F.struct(b.alias("b"), a.alias("a")))
        grid = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(float(np.log10(f))).alias("x")) for f in self.freqs[idx]])
        away = lambda y, g: F.struct((y - (F.col("_fit.a") + F.col("_fit.b") * g["x"])).alias("r"), g["f"].alias("f"))
        return df.withColumn("_res", F.zip_with(self._pick(F.col(log_spectrum), idx), grid, away))

    def with_slope_fit(self, df: DataFrame, log_spectrum: str, name: str, lo: float, hi: float, exclude: tuple[float, float] | None) -> DataFrame:
        """Add struct ``name``: exponent and root-mean-square residual of the line."""
        idx = self._fit_index(lo, hi, exclude)
        df = self._residuals(df, log_spectrum, idx, (lo, hi), exclude)
        total = F.aggregate("_res", F.lit(0.0), lambda a, s: a + s["r"] * s["r"])
        fitted = F.struct((-F.col("_fit.b")).alias("exponent"), F.sqrt(total / F.lit(float(idx.size))).alias("rmse"))
        return df.withColumn(name, fitted).drop("_fit", "_res")

    def with_alpha_peak(self, df: DataFrame, log_spectrum: str, name: str, fit: tuple[float, float] = BACKGROUND_FIT_HZ) -> DataFrame:
        """Add struct ``name`` (frequency, height) of the alpha maximum above the fitted line.

        The frequency is NULL below the minimum height; both are NULL if any bin of the spectrum is missing.
        """
        df = self._residuals(df, log_spectrum, self._between(*ALPHA_SEARCH_HZ, closed=True), fit, BACKGROUND_EXCLUDE_HZ)
        start = F.struct(F.lit(float("-inf")).alias("r"), F.lit(0.0).alias("f"))
        # first maximum: a later bin must be strictly higher
        df = df.withColumn("_best", F.aggregate("_res", start, lambda a, s: F.when(s["r"] > a["r"], s).otherwise(a)))
        near = F.filter("_res", lambda s: (F.abs(s["f"] - F.col("_best.f")) <= CENTROID_HALF_WIDTH_HZ) & (s["r"] > 0))
        sums = F.aggregate(
            near, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wf")),
            lambda a, s: F.struct((a["w"] + s["r"]).alias("w"), (a["wf"] + s["r"] * s["f"]).alias("wf")),
        )
        df = df.withColumn("_sums", sums)
        whole = ~F.exists(log_spectrum, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
        height = F.when(whole, F.col("_best.r"))
        peak = F.struct(F.when(height >= MIN_PEAK_LOG10, F.col("_sums.wf") / F.col("_sums.w")).alias("frequency"), height.alias("height"))
        return df.withColumn(name, peak).drop("_fit", "_res", "_best", "_sums")

    def prominence(self, spectrum: Column) -> Column:
        """Maximum of log10 power in 8-13 Hz minus the mean of two flanks (5-7 and 14-17 Hz)."""
        log_s = F.transform(spectrum, lambda s: F.log10(s))

        def mean(lo: float, hi: float) -> Column:
            idx = self._between(lo, hi, closed=True)
            return self._sum(self._pick(log_s, idx)) / F.lit(float(idx.size))

        peak = F.array_max(self._pick(log_s, self._between(8.0, 13.0, closed=True)))
        return peak - 0.5 * (mean(5.0, 7.0) + mean(14.0, 17.0))


def log10_array(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda s: F.log10(s))
