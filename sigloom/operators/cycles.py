"""Cycle folding: half-record averages of 4-s cycles, their waveforms, and randomised group statistics.

Averages, group statistics and p-values are Spark aggregations. Waveform alignment is a small vector kernel on
the records of one partition; the randomisation keeps records where they are and sends only weighted sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import folds, ordered, recordings, replicates
from sigloom.session import checkpointed

# Fixed values
BEAT_S, BEATS, CYCLE = 0.5, 8, 500
BIN_HZ = 0.25
N_BINS = CYCLE // 2 + 1
BAND_HZ = (1.0, 20.0)
CONFIRM_BAND_HZ = (2.0, 8.0)
FRONTAL = ("Fp1", "Fp2")
GRID_HZ = (2.0, 4.0, 6.0, 8.0, 10.0)
ODD_HZ = (1.0, 3.0, 5.0, 7.0, 9.0)
PHASE_HZ = (2.0, 4.0, 6.0)
MIN_CYCLES_PER_HALF = 3
FINE_HZ, FINE, BEAT = 500.0, 2000, 250
N1_POINTS = 50
SEARCH = (25, 200)
EPOCH = (-50, 300)
MMN, P3A = (0.10, 0.25), (0.25, 0.40)
AGREEMENT_S = 0.1
GAIN = 4.0 / 3.0
N_SURROGATES = 2000
RECORDS = 256
DIRECTION = {"grid_r": 1, "odd_r": 1, "deviant_r": 1, "curve_energy": 1, "mmn_mean": -1, "p3a_mean": 1, "onset_agreement": 1, "tau_agreement": 1}
STATS = ("grid_r", "odd_r", "deviant_r", "onset_agreement", "tau_agreement")
TIMES = np.arange(*EPOCH) / FINE_HZ


def harmonics(hz: Sequence[float]) -> np.ndarray:
    """Bins of exact frequencies."""
    return np.array([round(f / BIN_HZ) for f in hz])


def offbeat(band: tuple[float, float] = BAND_HZ) -> np.ndarray:
    """Bins of the band that no train of equal half-second pairs can fill: all but the whole hertz."""
    every = np.arange(math.ceil(band[0] / BIN_HZ), math.floor(band[1] / BIN_HZ) + 1)
    return every[every % round(1 / BIN_HZ) > 0]


def beat_bins(band: tuple[float, float] = BAND_HZ) -> np.ndarray:
    k = np.arange(N_BINS)
    return k[(k % BEATS == 0) & (k * BIN_HZ >= band[0]) & (k * BIN_HZ <= band[1])]


def good_cycles(files: DataFrame, cfg: recordings.Conditioning = recordings.CYCLES) -> DataFrame:
    """Band-passed cycles kept per channel: small range, no bad sample, channel not copied."""
    w = recordings.flagged_windows(files, cfg)
    bad = recordings.Reject.RAIL | recordings.Reject.DROPOUT | recordings.Reject.AMPLITUDE | recordings.Reject.COPY
    return w.filter(F.col("reject").bitwiseAND(F.lit(int(bad))) == 0).select("path", "channel", F.col("window_idx").alias("cycle"), "x")


def mean_arrays(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """Element-wise mean of arrays per key, from partial sums per position, and the number of rows."""
    cells = df.select(*keys, F.posexplode(x).alias("bin", "v")).groupBy(*keys, "bin").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("bin", "v")))
    return cells.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(name), F.max("n").alias("n_rows"))


def spectrum_of(x: str) -> Column:
    """Struct (re, im) of the real FFT of an array column."""

    @F.pandas_udf("struct<re array<double>, im array<double>>")
    def rfft(values: pd.Series) -> pd.DataFrame:
        s = [np.fft.rfft(np.asarray(v, dtype=float)) for v in values]
        return pd.DataFrame({"re": [v.real for v in s], "im": [v.imag for v in s]})

    return rfft(x)


def half_spectra(cycles: DataFrame) -> DataFrame:
    """Per (path, channel, half): spectrum of the mean of the even or odd cycles, and their number."""
    halves = cycles.withColumn("half", (F.col("cycle") % 2).cast("int"))
    m = mean_arrays(halves, ["path", "channel", "half"], "x", "mean")
    return m.select("path", "channel", "half", F.col("n_rows").alias("n_cycles"), spectrum_of("mean").alias("s")).select("path", "channel", "half", "n_cycles", "s.re", "s.im")


def phase_consistency(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Column:
    """Cosine of the phase difference of two complex numbers."""
    return (a_re * b_re + a_im * b_im) / F.sqrt((a_re * a_re + a_im * a_im) * (b_re * b_re + b_im * b_im))


def split_phase_consistency(cycles: DataFrame, channels: Sequence[str] = FRONTAL) -> DataFrame:
    """Phase agreement per (path, split, bin) of two halves, interleaved and in blocks, of cycles kept on all channels."""
    both = cycles.filter(F.col("channel").isin(*channels))
    kept = both.groupBy("path", "cycle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(channels)).drop("n")
    order = Window.partitionBy("path").orderBy("cycle")
    kept = kept.withColumns({"i": F.row_number().over(order) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy("path"))}).filter(F.col("m") >= 2 * MIN_CYCLES_PER_HALF)
    sides = F.array(
        F.struct(F.lit("interleaved").alias("split"), (F.col("cycle") % 2).cast("int").alias("half")),
        F.struct(F.lit("blocks").alias("split"), F.when(F.col("i") < F.floor(F.col("m") / 2), 0).otherwise(1).alias("half")),
    )
    rows = both.join(kept.select("path", "cycle", F.explode(sides).alias("s")), ["path", "cycle"]).select("path", "s.split", "s.half", "x")
    m = mean_arrays(rows, ["path", "split", "half"], "x", "mean").select("path", "split", "half", spectrum_of("mean").alias("s"))
    pick = lambda h, part: F.max(F.when(F.col("half") == h, F.col(f"s.{part}")))
    wide = m.groupBy("path", "split").agg(pick(0, "re").alias("ar"), pick(0, "im").alias("ai"), pick(1, "re").alias("br"), pick(1, "im").alias("bi"))
    long = wide.select("path", "split", F.posexplode(F.arrays_zip("ar", "ai", "br", "bi")).alias("bin", "z"))
    return long.select("path", "split", "bin", phase_consistency(F.col("z.ar"), F.col("z.ai"), F.col("z.br"), F.col("z.bi")).alias("cosine"))


def record_spectra(halves: DataFrame, channels: Sequence[str] = FRONTAL, min_cycles: int = MIN_CYCLES_PER_HALF) -> DataFrame:
    """One row per valid record: primary spectra of both halves, real and imaginary parts as arrays."""
    mine = halves.filter(F.col("channel").isin(*channels) & (F.col("n_cycles") >= min_cycles))
    cols = []
    for h in (0, 1):
        for part in ("re", "im"):
            for ch in channels:
                cols.append(F.max(F.when((F.col("half") == h) & (F.col("channel") == ch), F.col(part))).alias(f"_{part}{h}_{ch}"))
    wide = mine.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("n_cycles").alias("n_cycles"), *cols).filter(F.col("_n") == 2 * len(channels))
    mean = {}
    for h in (0, 1):
        for part in ("re", "im"):
            total = F.col(f"_{part}{h}_{channels[0]}")
            for ch in channels[1:]:
                total = F.zip_with(total, F.col(f"_{part}{h}_{ch}"), lambda a, b: a + b)
            mean[f"{part}{h}"] = F.transform(total, lambda v: v / len(channels))
    return wide.select("path", "n_cycles", *[c.alias(n) for n, c in mean.items()])


class Series:
    """Some bins of the spectra of a block of records; a delay is a phase, agreement an inner product."""

    def __init__(self, spectra: np.ndarray, bins: np.ndarray) -> None:
        self.bins, self.part = bins, spectra[:, bins]
        self.size = np.sqrt((np.abs(self.part) ** 2).sum(axis=1))

    def turned(self, steps: np.ndarray) -> np.ndarray:
        """Factors that delay each record by its number of 2-ms steps."""
        return np.exp(-2j * np.pi * np.outer(steps, self.bins) / FINE)

    def values(self, at: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
        """The waveform at the given steps, each record read ``ahead`` of its zero."""
        part = self.part if ahead is None else self.part * self.turned(-ahead)
        return (part @ np.exp(2j * np.pi * np.outer(self.bins, at) / FINE)).real * (2 / CYCLE)

    def agreement(self, other: Series, delay: np.ndarray) -> np.ndarray:
        """Normalised inner product with ``other`` delayed, by Parseval's theorem; no value where one of them is nought."""
        inner = (self.part.conj() * other.part * other.turned(delay)).real.sum(axis=1)
        scale = self.size * other.size
        return np.where(scale > 0, inner / np.where(scale > 0, scale, 1), np.nan)


class Landmarks:
    """Onset of the beat and of the deviant within the cycle, in steps. A delay of the record only adds to both."""

    def __init__(self, spectra: np.ndarray, late: Series) -> None:
        beat = Series(spectra, harmonics(PHASE_HZ)).values(np.arange(BEAT))
        self.beat = (beat.argmin(axis=1) - N1_POINTS) % BEAT
        power = late.values(np.arange(FINE)) ** 2
        run = np.cumsum(np.concatenate([np.zeros((len(power), 1)), power, power], axis=1), axis=1)
        first = (self.beat[:, None] + BEAT * np.arange(BEATS)) % FINE
        pick = lambda i: np.take_along_axis(run, i, axis=1)
        search = (first + SEARCH[0]) % FINE
        held = pick(search + SEARCH[1] - SEARCH[0]) - pick(search)
        self.deviant = first[np.arange(len(first)), held.argmax(axis=1)]


class Agreement:
    """Both halves of the records of one block; the second half may be delayed."""

    def __init__(self, first: np.ndarray, second: np.ndarray, band: tuple[float, float]) -> None:
        bins = {"grid_r": harmonics(GRID_HZ), "odd_r": harmonics(ODD_HZ), "deviant_r": offbeat(band)}
        self.first, self.second = ({name: Series(s, b) for name, b in bins.items()} for s in (first, second))
        self.marks = [Landmarks(s, series["deviant_r"]) for s, series in ((first, self.first), (second, self.second))]

    def at(self, delay: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics, landmarks in steps, and the curve around the deviant that each half finds in the other."""
        one, two = self.marks
        beat, deviant = (two.beat + delay) % BEAT, (two.deviant + delay) % FINE
        out = {name: series.agreement(self.second[name], delay) for name, series in self.first.items()}
        for name, gap, period in (("onset_agreement", one.beat - beat, BEAT), ("tau_agreement", one.deviant - deviant, FINE)):
            out[name] = (np.abs((gap + period // 2) % period - period // 2) / FINE_HZ < AGREEMENT_S).astype(float)
        epoch = np.arange(*EPOCH)
        across = self.second["deviant_r"].values(epoch, one.deviant - delay) + self.first["deviant_r"].values(epoch, deviant)
        return out | {"onset_a": one.beat, "onset_b": beat, "tau_a": one.deviant, "tau_b": deviant, "curve": 0.5 * GAIN * across}


def _block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    part = lambda n: np.stack(pdf[n].to_numpy()).astype(float)
    return part("re0") + 1j * part("im0"), part("re1") + 1j * part("im1")


def _few(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same records, at most ``RECORDS`` at a time: waveforms and energies of one take some 100 kB in a task."""
    for pdf in blocks:
        yield from (pdf.iloc[low : low + RECORDS] for low in range(0, len(pdf), RECORDS))


def record_measures(records: DataFrame, band: tuple[float, float] = BAND_HZ) -> DataFrame:
    """Observed agreement, onsets (seconds) and curve of every record."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _few(blocks):
            m = Agreement(*_block(pdf), band).at(np.zeros(len(pdf), dtype=int))
            out = {"path": pdf["path"].to_numpy(), "subject": pdf["subject"].to_numpy(), **{k: m[k] for k in STATS}}
            out |= {f"{k}_s": m[k] / FINE_HZ for k in ("onset_a", "onset_b", "tau_a", "tau_b")}
            yield pd.DataFrame({**out, "curve": list(m["curve"])})

    cols = ", ".join(f"{c} double" for c in (*STATS, "onset_a_s", "onset_b_s", "tau_a_s", "tau_b_s"))
    return records.select("path", "subject", "re0", "im0", "re1", "im1").mapInPandas(run, f"path string, subject string, {cols}, curve array<double>")


def delay_base(seed: int) -> Column:
    """31-bit number from which the delays of a record's surrogates follow."""
    return folds.hash_number(seed, F.col("path")).bitwiseAND(F.lit(replicates.BITS))


def random_delays(base: np.ndarray, surrogates: np.ndarray) -> np.ndarray:
    """(record, surrogate): delay of the second half in steps."""
    return replicates.mixed(replicates.mixed((base[:, None].astype(np.int64) + surrogates) & replicates.BITS) ^ replicates.SECOND & replicates.BITS) % FINE


def record_weights(measures: DataFrame) -> DataFrame:
    """Weights ``w`` of a record in the group means, one a statistic and one for the curve: valid records of a subject, then subjects, count alike."""
    valid = [F.when(F.isnan(s) | F.col(s).isNull(), 0.0).otherwise(1.0).alias(f"_v{i}") for i, s in enumerate(STATS)] + [F.lit(1.0).alias(f"_v{len(STATS)}")]
    rows, n = measures.select("path", "subject", *valid), len(valid)
    per = rows.groupBy("subject").agg(*[F.sum(f"_v{i}").alias(f"_k{i}") for i in range(n)])
    total = per.agg(*[F.count_if(F.col(f"_k{i}") > 0).alias(f"_g{i}") for i in range(n)])  # one row
    both = rows.join(per, "subject").crossJoin(F.broadcast(total))
    return both.select("path", F.array(*[F.when(F.col(f"_v{i}") > 0, 1.0 / (F.col(f"_k{i}") * F.col(f"_g{i}"))).otherwise(0.0) for i in range(n)]).alias("w"))


def surrogate_sums(records: DataFrame, measures: DataFrame, n_surrogates: int, seed: int, band: tuple[float, float] = BAND_HZ) -> DataFrame:
    """Group statistics and mean curve per surrogate: (surrogate, pos, value), the same means as the observed ones.

    Whether a record has an agreement does not depend on the delay, so its weights are those of the observed data; group means are
    weighted sums and each partition sends one row of sums per surrogate. The full onset search is repeated for every surrogate.
    """
    rows = records.join(record_weights(measures), "path").withColumn("_base", delay_base(seed))
    size = len(STATS) + TIMES.size

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_surrogates, size))
        for pdf in _few(blocks):
            halves, w, base = Agreement(*_block(pdf), band), np.stack(pdf["w"].to_numpy()), pdf["_base"].to_numpy()
            for s in range(n_surrogates):
                m = halves.at(random_delays(base, np.array([s]))[:, 0])
                sums[s, : len(STATS)] += [w[:, i] @ np.nan_to_num(m[k]) for i, k in enumerate(STATS)]
                sums[s, len(STATS) :] += w[:, -1] @ m["curve"]
        yield pd.DataFrame({"surrogate": np.repeat(np.arange(n_surrogates), size), "pos": np.tile(np.arange(size), n_surrogates), "v": sums.ravel()})

    parts = rows.select("path", "re0", "im0", "re1", "im1", "w", "_base").mapInPandas(run, "surrogate int, pos int, v double")
    return parts.groupBy("surrogate", "pos").agg(F.sum("v").alias("v"))


def _curve_stats(sums: DataFrame, key: str) -> DataFrame:
    """The eight group statistics per key from (key, pos, v)."""
    k = len(STATS)
    t = F.lit(EPOCH[0] / FINE_HZ) + (F.col("pos") - k) / FINE_HZ
    within = lambda lo, hi: (F.col("pos") >= k) & (t >= lo - 1e-9) & (t < hi - 1e-9)
    aggs = [F.max(F.when(F.col("pos") == i, F.col("v"))).alias(n) for i, n in enumerate(STATS)]
    aggs.append(F.avg(F.when(within(0.05, 0.40), F.col("v") * F.col("v"))).alias("curve_energy"))
    aggs += [F.avg(F.when(within(*span), F.col("v"))).alias(n) for n, span in (("mmn_mean", MMN), ("p3a_mean", P3A))]
    return sums.groupBy(key).agg(*aggs)


def group_statistics(measures: DataFrame) -> DataFrame:
    """Observed group statistics: records averaged within subjects, then subjects."""
    k = len(STATS)
    stacked = F.concat(F.array(*[F.nanvl(F.col(s), F.lit(None).cast("double")) for s in STATS]), F.col("curve"))
    cells = measures.select("subject", F.posexplode(stacked).alias("pos", "v"))
    per = cells.groupBy("subject", "pos").agg(F.avg("v").alias("v")).groupBy("pos").agg(F.avg("v").alias("v"))
    return _curve_stats(per.withColumn("_one", F.lit(1)), "_one").drop("_one")


def report(records: DataFrame, n_surrogates: int = N_SURROGATES, seed: int = 42, band: tuple[float, float] = BAND_HZ) -> DataFrame:
    """One row per statistic: observed value, null mean and quantiles, one-sided p."""
    records = checkpointed(records)
    measures = checkpointed(record_measures(records, band))
    observed = group_statistics(measures)
    names = list(DIRECTION)
    obs = observed.withColumn("_one", F.lit(1)).unpivot("_one", names, "statistic", "observed").drop("_one")
    null = checkpointed(_curve_stats(surrogate_sums(records, measures, n_surrogates, seed, band), "surrogate")).unpivot("surrogate", names, "statistic", "v")
    sign = F.create_map(*[F.lit(v) for n, d in DIRECTION.items() for v in (n, d)])
    joined = null.join(obs, "statistic")
    extreme = (F.col("v") - F.col("observed")) * F.element_at(sign, F.col("statistic")) >= 0
    p = joined.groupBy("statistic").agg(
        F.max("observed").alias("observed"), F.avg("v").alias("null_mean"), ((1 + F.count_if(extreme)) / (1 + F.count("v"))).alias("p")
    )
    return p.join(ordered.quantiles(null, ["statistic"], "v", {"null_q05": 0.05, "null_q95": 0.95}), "statistic")


def channel_correlations(halves: DataFrame, bins: np.ndarray) -> DataFrame:
    """Uncentred correlation of the two halves per (path, channel), straight from the spectra.

    By Parseval the circular waveforms of the chosen bins correlate as their spectra do.
    """
    pos = F.array(*[F.lit(int(b) + 1) for b in bins])
    pick = lambda c: F.transform(pos, lambda i: F.element_at(c, i))
    side = lambda h, part: F.max(F.when(F.col("half") == h, pick(F.col(part)))).alias(f"{part}{h}")
    wide = halves.groupBy("path", "channel").agg(*[side(h, part) for h in (0, 1) for part in ("re", "im")])
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    num = dot("re0", "re1") + dot("im0", "im1")
    den = F.sqrt((dot("re0", "re0") + dot("im0", "im0")) * (dot("re1", "re1") + dot("im1", "im1")))
    return wide.select("path", "channel", F.when(den > 0, num / den).alias("r"))
