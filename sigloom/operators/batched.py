"""Many logistic fits of one large table at once: every training set of a nested evaluation shares each pass over the rows.

A training set is all rows but those of an outer fold, an inner fold and, for some candidates, a stratum. Tasks hold a 0/1 matrix of
training sets by rows for one Arrow batch: sums for all sets are one matrix product. Exact medians come from counting
refinement: each pass fixes four more bits of all medians. A Newton pass returns loss, gradient and Hessian of every fit that has
not settled; settled fits take no part in the next. The number of jobs follows neither the folds nor the candidates, only the blocks
of fits whose sums the driver holds at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import learn, metrics
from sigloom.session import checkpointed

BLOCK_BYTES = 64 << 20
DIGIT = 4
NONE = -1


@dataclass(frozen=True)
class Fit:
    """One training set and setting: ``outer`` and ``fold`` left out (``NONE``: none), columns, weight of the specific strata, C."""

    outer: int
    fold: int
    control: bool
    columns: tuple[int, ...]
    spec_weight: float
    c: float
    candidate: int

    @property
    def base(self) -> tuple[int, int, bool]:
        return self.outer, self.fold, self.control


@dataclass
class Standard:
    """Fill, mean and scale per (training set, feature), and class masses per training set."""

    bases: list[tuple[int, int, bool]]
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    mass: np.ndarray  # rows, cases, specific rows, specific cases

    def weights(self, b: int, spec_weight: float) -> tuple[float, float]:
        """Factors of cases and others that give both classes the same total."""
        rows, cases, spec, spec_cases = self.mass[b]
        every, pos = rows + (spec_weight - 1) * spec, cases + (spec_weight - 1) * spec_cases
        return every / (2 * pos) if pos else 1.0, every / (2 * (every - pos)) if every > pos else 1.0


class _Batch:
    """One Arrow batch as arrays."""

    def __init__(self, pdf: pd.DataFrame, features: Sequence[str]) -> None:
        self.x = pdf[list(features)].to_numpy(dtype=float)
        self.y = pdf["y"].to_numpy(dtype=float)
        self.outer, self.fold, self.row, self.stratum = (pdf[c].to_numpy() for c in ("outer", "fold", "row", "stratum"))
        self.spec = np.isin(self.stratum.astype(str), strata.SPECIFICITY_STRATA).astype(float)
        self.somatoform = self.stratum == strata.SOMATOFORM

    def training(self, base: tuple[int, int, bool]) -> np.ndarray:
        outer, fold, control = base
        return (self.outer != outer) & (self.fold != fold) & ~(self.somatoform & control)

    def sets(self, bases: list[tuple[int, int, bool]]) -> np.ndarray:
        return np.array([self.training(b) for b in bases], float)


def _summed(rows: DataFrame, features: Sequence[str], shape: tuple[int, ...], part: Callable[[_Batch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of an array of fixed shape, one row of bytes a leading index and partition on the way."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for block in blocks:
            if len(block):
                total += part(_Batch(block, features))
        yield pd.DataFrame({"k": np.arange(shape[0]), "v": [a.tobytes() for a in total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    found = rows.mapInPandas(run, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    out = np.zeros(shape)
    for r in found:
        out[r["k"]] = np.frombuffer(bytes(r["v"])).reshape(shape[1:])
    return out


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63) == 1, keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def medians(rows: DataFrame, features: Sequence[str], bases: list[tuple[int, int, bool]], count: np.ndarray) -> np.ndarray:
    """Median of the present values per (training set, feature); ``count`` says how many there are. 0 where there is none."""
    p, ways = len(features), 1 << DIGIT
    wanted = np.stack([(count - 1) // 2, count // 2]).astype(np.int64) + 1  # how many values must be reached
    prefix = np.zeros((2, len(bases), p), np.uint64)
    for done in range(0, 64, DIGIT):
        low = 64 - done - DIGIT
        digits = (np.arange(ways - 1, dtype=np.uint64) << np.uint64(low)) | np.uint64((1 << low) - 1)
        bounds = prefix[..., None] | digits

        def counts(batch: _Batch, bounds=bounds) -> np.ndarray:
            member, out = batch.sets(bases), np.zeros((len(bases), p, 2 * (ways - 1)))
            for j in range(p):
                there = np.flatnonzero(~np.isnan(batch.x[:, j]))
                key = ordered_keys(batch.x[there, j])
                order = np.argsort(key)
                upto = np.concatenate([np.zeros((len(bases), 1)), np.cumsum(member[:, there[order]], axis=1)], axis=1)
                at = np.searchsorted(key[order], bounds[:, :, j, :], side="right")
                for k in range(2):
                    out[:, j, k * (ways - 1) : (k + 1) * (ways - 1)] = np.take_along_axis(upto, at[k], axis=1)
            return out

        reached = _summed(rows, features, (len(bases), p, 2 * (ways - 1)), counts).reshape(len(bases), p, 2, ways - 1)
        digit = (reached < wanted.transpose(1, 2, 0)[..., None]).sum(axis=-1).astype(np.uint64)
        prefix |= digit.transpose(2, 0, 1) << np.uint64(low)
    return np.where(count > 0, from_keys(prefix).mean(axis=0), 0.0)


def standardised(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], scale: bool = True) -> Standard:
    """Fill, mean and population deviation of every training set, in passes shared by all."""
    bases, p = sorted({f.base for f in fits}), len(features)

    def sizes(batch: _Batch) -> np.ndarray:
        flags = np.column_stack([np.ones(len(batch.y)), batch.y, batch.spec, batch.y * batch.spec, ~np.isnan(batch.x)])
        return batch.sets(bases) @ flags

    found = _summed(rows, features, (len(bases), 4 + p), sizes)
    mass, count = found[:, :4], found[:, 4:]
    if not scale:
        return Standard(bases, np.zeros((len(bases), p)), np.zeros((len(bases), p)), np.ones((len(bases), p)), mass)
    fill = medians(rows, features, bases, count)
    centre = fill[0]

    def moments(batch: _Batch) -> np.ndarray:
        d = np.nan_to_num(batch.x - centre, nan=0.0)
        return batch.sets(bases) @ np.column_stack([d, d * d])

    sums = _summed(rows, features, (len(bases), 2 * p), moments)
    n, gap = np.maximum(mass[:, :1], 1), mass[:, :1] - count
    first, second = sums[:, :p] + gap * (fill - centre), sums[:, p:] + gap * (fill - centre) ** 2
    mean = first / n
    var = second / n - mean**2
    sd = np.sqrt(np.where(var > 1e-12 * second / n, var, 0.0))
    return Standard(bases, fill, mean + centre, np.where(sd > 0, sd, 1.0), mass)


def fit_all(rows: DataFrame, features: Sequence[str], fits: list[Fit], scale: bool = True) -> tuple[Standard, list[np.ndarray]]:
    """Coefficients (with the intercept last) of all fits; raises if one does not settle."""
    std = standardised(rows, features, fits, scale)
    at = {b: i for i, b in enumerate(std.bases)}
    states: list[learn.Damped | None] = []
    beta: list[np.ndarray] = []
    for f in fits:
        total, cases = std.mass[at[f.base], :2]
        one = total == 0 or cases in (0, total)
        beta.append(np.append(np.zeros(len(f.columns)), (learn.ONE_CLASS if total and cases else -learn.ONE_CLASS) if one else 0.0))
        states.append(None if one else learn.Damped(len(f.columns) + 1, f.c, 1e-8))
    widest = max(len(f.columns) for f in fits) + 1
    for _ in range(learn.MAX_STEPS):
        live = [i for i, s in enumerate(states) if s is not None]
        if not live:
            return std, beta
        sums = _newton_sums(rows, features, std, [(fits[i], states[i].beta) for i in live], widest)
        for i, flat in zip(live, sums, strict=True):
            m, s = len(fits[i].columns) + 1, states[i]
            if s.advance(flat[0], flat[1 : m + 1], flat[m + 1 : m + 1 + m * m].reshape(m, m)):
                beta[i], states[i] = s.beta, None
    raise RuntimeError("a logistic fit did not converge")


def _newton_sums(rows: DataFrame, features: Sequence[str], std: Standard, live: list[tuple[Fit, np.ndarray]], widest: int) -> np.ndarray:
    shape = (len(live), 1 + widest + widest**2)
    by_base: dict[tuple[int, int, bool], list[int]] = {}
    for k, (f, _) in enumerate(live):
        by_base.setdefault(f.base, []).append(k)
    shared = rows.sparkSession.sparkContext.broadcast((std, live, by_base))

    def part(batch: _Batch) -> np.ndarray:
        std, live, by_base = shared.value
        out = np.zeros(shape)
        for b, base in enumerate(std.bases):
            if base not in by_base:
                continue
            at = np.flatnonzero(batch.training(base))
            z = _standard(batch.x[at], std, b)
            for k in by_base[base]:
                f, now = live[k]
                x = np.column_stack([z[:, f.columns], np.ones(len(at))])
                cases, others = std.weights(b, f.spec_weight)
                w = np.where(batch.spec[at] > 0, f.spec_weight, 1.0) * np.where(batch.y[at] == 1, cases, others)
                grad, hess = learn.newton_sums(x, batch.y[at], w, now)
                flat = np.concatenate([[learn.logistic_loss(x, batch.y[at], w, now)], grad, hess.ravel()])
                out[k, : len(flat)] = flat
        return out

    return _summed(rows, features, shape, part)


def _standard(x: np.ndarray, std: Standard, b: int) -> np.ndarray:
    return (np.where(np.isnan(x), std.fill[b], x) - std.mean[b]) / std.scale[b]


def predicted(rows: DataFrame, features: Sequence[str], fits: list[Fit], inner: bool, scale: bool = True, hidden: Sequence[str] = ()) -> DataFrame:
    """Probabilities of the rows that each fit left out: ``outer, candidate, row, stratum, y, p``.

    ``inner``: rows of the fit's inner fold outside its outer fold; else rows of its outer fold. ``hidden`` features count as missing.
    """
    room = max(1, BLOCK_BYTES // (8 * (len(features) + 2) ** 2))
    out = None
    for low in range(0, len(fits), room):
        block = fits[low : low + room]
        std, beta = fit_all(rows, features, block, scale)
        part = _predict(rows, features, block, std, beta, inner, [list(features).index(n) for n in hidden if n in features])
        out = part if out is None else out.unionByName(part)
    return out


def _predict(rows: DataFrame, features: Sequence[str], fits: list[Fit], std: Standard, beta: list[np.ndarray], inner: bool, hidden: list[int]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((std, fits, beta))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        std, fits, beta = shared.value
        at = {b: i for i, b in enumerate(std.bases)}
        for block in blocks:
            if not len(block):
                continue
            batch = _Batch(block, features)
            batch.x[:, hidden] = np.nan
            for f, own in zip(fits, beta, strict=True):
                test = np.flatnonzero((batch.outer != f.outer) & (batch.fold == f.fold) if inner else batch.outer == f.outer)
                if len(test):
                    z = _standard(batch.x[test], std, at[f.base])[:, f.columns] @ own[:-1] + own[-1]
                    yield pd.DataFrame({"outer": f.outer, "candidate": f.candidate, "row": batch.row[test], "stratum": batch.stratum[test], "y": batch.y[test], "p": 1 / (1 + np.exp(-np.clip(z, -700, 700)))})

    return rows.mapInPandas(run, "outer long, candidate int, row long, stratum string, y double, p double")


def platt_all(oof: DataFrame, key: str, balanced: bool, equal_error: bool) -> DataFrame:
    """Slope and offset per value of ``key``; a step of all of them is one aggregation."""
    spark = oof.sparkSession
    rows = oof.select(key, "stratum", F.col("y").cast("double").alias("y"), learn.platt_logit(F.col("p")).alias("x"))
    size = rows.groupBy(key).agg(F.sum("y").alias("_np"), F.count(F.lit(1)).alias("_n"))
    balance = F.when(F.col("y") == 1, F.col("_n") / (2 * F.col("_np"))).otherwise(F.col("_n") / (2 * (F.col("_n") - F.col("_np"))))
    rows = checkpointed(rows.join(F.broadcast(size), key).withColumn("w", balance if balanced else F.lit(1.0)))  # one row a fold
    packed = checkpointed(rows.groupBy(key, "x", "y").agg(F.sum("w").alias("w")))
    done: dict[int, tuple[float, float]] = {}
    states: dict[int, learn.Damped] = {}
    for r in rows.groupBy(key).agg(F.min("y").alias("low"), F.max("y").alias("high")).collect():
        if r["low"] == r["high"]:
            done[r[key]] = (0.0, learn.ONE_CLASS if r["high"] == 1 else -learn.ONE_CLASS)
        else:
            states[r[key]] = learn.Damped(2, learn.PLATT_C, 1e-10)
    for _ in range(learn.MAX_STEPS):
        if not states:
            break
        now = spark.createDataFrame([(k, *map(float, s.beta)) for k, s in states.items()], f"{key} long, a double, b double")
        z = F.col("a") * F.col("x") + F.col("b")
        some = packed.join(F.broadcast(now), key).withColumn("z", F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))).withColumn("q", 1 / (1 + F.exp(-F.col("z"))))
        w, q, x, y = (F.col(c) for c in "wqxy")
        h = w * q * (1 - q)
        loss = w * (F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - y * F.col("z"))
        sums = some.groupBy(key).agg(*[F.sum(e).alias(n) for n, e in (("l", loss), ("ga", w * (q - y) * x), ("gb", w * (q - y)), ("haa", h * x * x), ("hab", h * x), ("hbb", h))])
        for r in sums.collect():
            s = states[r[key]]
            if s.advance(r["l"], np.array([r["ga"], r["gb"]]), np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]])):
                done[r[key]] = (float(s.beta[0]), float(s.beta[1]))
                del states[r[key]]
    else:
        raise RuntimeError("a calibration did not converge")
    fitted = spark.createDataFrame([(k, a, b) for k, (a, b) in done.items()], f"{key} long, a double, b double")
    if not equal_error:
        return fitted
    moved = rows.join(F.broadcast(fitted), key)
    moved = moved.withColumn("z", F.greatest(F.least(F.col("a") * F.col("x") + F.col("b"), F.lit(27.6)), F.lit(-27.6)))
    shift = metrics.equal_error_shift(moved, "z", F.col("y") == 1, F.col("stratum").isin(*strata.SPECIFICITY_STRATA), "shift", [key])
    return fitted.join(shift, key, "left").select(key, "a", (F.col("b") - F.coalesce("shift", F.lit(0.0))).alias("b"))
