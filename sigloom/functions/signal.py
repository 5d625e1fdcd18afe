"""Arrow-batched signal kernels used inside tasks: one array in, one array out."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


STACK_ROWS = 500


def stacked(values: pd.Series, kernel) -> pd.Series:
    """Apply a matrix kernel to the arrays of one length, ``STACK_ROWS`` at a time."""
    out: list[object] = [None] * len(values)
    sizes = np.array([-1 if v is None else len(v) for v in values])
    for n in np.unique(sizes[sizes >= 0]):
        same = np.flatnonzero(sizes == n)
        for low in range(0, len(same), STACK_ROWS):
            rows = same[low : low + STACK_ROWS]
            block = kernel(np.stack([np.asarray(values.iloc[i], dtype=float) for i in rows]))
            for i, row in zip(rows, block):
                out[i] = row
    return pd.Series(out, dtype=object)


def hann_psd(x: np.ndarray, sfreq: float) -> np.ndarray:
    """One-sided density periodogram with a periodic Hann taper, no detrending."""
    n = x.shape[-1]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(x * taper, axis=-1)) ** 2 / (sfreq * np.sum(taper**2))
    power[..., 1 : (n + 1) // 2] *= 2
    return power


def psd(x: Column, sfreq: float, centred: bool = False) -> Column:
    """``ARRAY<DOUBLE>`` samples -> ``ARRAY<DOUBLE>`` power per frequency bin; ``centred`` takes the mean away first."""

    @F.pandas_udf("array<double>")
    def window_psd(v: pd.Series) -> pd.Series:
        return stacked(v, lambda m: hann_psd(m - m.mean(axis=-1, keepdims=True) if centred else m, sfreq))

    return window_psd(x)


def linear_detrend(x: np.ndarray) -> np.ndarray:
    """Remove the least-squares line of every row."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    slope = x @ t / np.maximum(t @ t, 1e-300)
    return x - x.mean(axis=-1, keepdims=True) - slope[..., None] * t


def detrended(x: Column) -> Column:
    @F.pandas_udf("array<double>")
    def window_detrend(v: pd.Series) -> pd.Series:
        return stacked(v, linear_detrend)

    return window_detrend(x)


def resample_ratio(sfreq: float, target: float) -> tuple[int, int]:
    r = Fraction(target / sfreq).limit_denominator(1000)
    return r.numerator, r.denominator


def resample_taps(up: int, down: int) -> np.ndarray:
    """Kaiser(5) low-pass for rational resampling; half length 10 * max(up, down), gain ``up``."""
    wide = max(up, down)
    half = 10 * wide
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / wide) / wide * np.kaiser(2 * half + 1, 5.0)
    return up * taps / taps.sum()


def fir_taps(sfreq: float, low: float | None, high: float | None) -> np.ndarray:
    """Zero-phase pass-band taps: one Hamming windowed sinc per cut-off, as long as its own transition needs."""
    edges = []
    if low is not None:
        width = min(max(0.25 * low, 2.0), low)
        edges.append((low - width / 2, width, -1))
    if high is not None:
        width = min(max(0.25 * high, 2.0), sfreq / 2 - high)
        edges.append((high + width / 2, width, 1))
    total = int(np.ceil(3.3 / min(w for _, w, _ in edges) * sfreq)) | 1
    taps = np.zeros(total)
    for cut, width, sign in edges:
        n = int(round(3.3 / width * sfreq))
        n += 1 - n % 2
        k = np.arange(n) - (n - 1) / 2
        part = np.sinc(2 * cut / sfreq * k) * np.hamming(n)
        margin = (total - n) // 2
        taps[margin : total - margin] += sign * part / part.sum()
    if high is None:
        taps[total // 2] += 1.0
    return taps


def butter_highpass_response(freqs: np.ndarray, order: int, cutoff: float) -> np.ndarray:
    """Complex response of the analogue Butterworth high-pass."""
    if order == 0:
        return np.ones_like(np.asarray(freqs, float), dtype=complex)
    s = 1j * np.asarray(freqs, float) / cutoff
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    out = np.ones_like(s)
    for p in poles:
        out = out * s / (s - 1 / p)
    return out


def _digital_poles(sfreq: float, order: int, cutoff: float) -> list[tuple[complex, complex]]:
    """Gain and feedback of each first-order section s / (s - p) under the bilinear transform."""
    warped, k = 2 * sfreq * np.tan(np.pi * cutoff / sfreq), 2 * sfreq
    poles = warped / np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    return [(k / (k - p), (k + p) / (k - p)) for p in poles]


def recurrence(u: np.ndarray, feed: complex, start: complex | np.ndarray = 0.0) -> np.ndarray:
    """y[i] = feed * y[i - 1] + u[i] along the last axis, by doubling: after k steps every value holds its last 2^k inputs."""
    y = np.array(u, dtype=complex)
    y[..., :1] += feed * np.asarray(start)[..., None]
    step, factor = 1, feed
    while step < y.shape[-1] and abs(factor) > 1e-300:
        y[..., step:] = y[..., step:] + factor * y[..., :-step]
        step, factor = 2 * step, factor * factor
    return y


def highpass_from(x: np.ndarray, sfreq: float, order: int, cutoff: float, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal Butterworth high-pass of one piece and the state behind it: the last input of each section and the last output."""
    y = np.asarray(x, dtype=complex)
    state = np.zeros((*y.shape[:-1], order + 1), complex) if state is None else state
    if not y.shape[-1]:
        return y.real, state
    behind = [y[..., -1]]
    for k, (gain, feed) in enumerate(_digital_poles(sfreq, order, cutoff)):
        u = gain * np.diff(y, axis=-1, prepend=state[..., k, None])
        y = recurrence(u, feed, state[..., k + 1])
        behind.append(y[..., -1])
    return y.real, np.stack(behind, axis=-1)


def highpass_transition(n: int, sfreq: float, order: int, cutoff: float) -> np.ndarray:
    """State behind ``n`` zero inputs for each unit state: matrix with the new state in rows."""
    _, out = highpass_from(np.zeros((order + 1, n)), sfreq, order, cutoff, np.eye(order + 1, dtype=complex))
    return out.T


def butter_highpass(x: np.ndarray, sfreq: float, order: int, cutoff: float) -> np.ndarray:
    """Causal digital Butterworth high-pass along the last axis from rest."""
    return np.array(x, dtype=float) if order == 0 else highpass_from(x, sfreq, order, cutoff)[0]
