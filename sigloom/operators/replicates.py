"""Bootstrap replicates as vectors: a task holds all replicates of its rows at once and returns one number a replicate.

How often a group is drawn follows from hashes of (seed, key, replicate, slot) alone, so a task computes the multiplicities of
just the groups that its rows belong to. Rows never meet replicates in a shuffle: they are cut into buckets, every bucket gives
mergeable sums per replicate (mass of either class, positives above negatives), and a table of replicates times buckets carries
the negatives of lower buckets to higher ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import folds, ordered

BITS = (1 << 31) - 1
# Fixed values of the mixing steps; products stay below 2^62, so SQL engines with 64-bit integers can follow
FACTORS = (0x2C1B3C6D, 0x297A2D39)
SHIFTS = (15, 12, 15)
SECOND = 0x5BD1E995
CELLS = 1 << 21
REP_BLOCKS = 8
GROUP_BLOCK = 50_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Mixes 31-bit numbers."""
    x = x ^ (x >> SHIFTS[0])
    x = (x * FACTORS[0]) & BITS
    x = x ^ (x >> SHIFTS[1])
    x = (x * FACTORS[1]) & BITS
    return x ^ (x >> SHIFTS[2])


def multiplicities(base: int, size: int, reps: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(wanted group, replicate): how often the group is among ``size`` draws with replacement from ``size`` groups."""
    out = np.empty((len(wanted), len(reps)))
    first = mixed((base + reps.astype(np.int64)) & BITS)
    second = mixed((first ^ SECOND) & BITS)
    slots, step = np.arange(size, dtype=np.int64), max(1, CELLS // max(size, 1))
    for low in range(0, len(reps), step):
        a, b = first[low : low + step, None], second[low : low + step, None]
        pick = mixed(mixed((a + slots) & BITS) ^ b) % size
        k = len(pick)
        counts = np.bincount((pick + size * np.arange(k)[:, None]).ravel(), minlength=k * size).reshape(k, size)
        out[:, low : low + step] = counts[:, wanted].T
    return out


def bucket_sums(score: np.ndarray, positive: np.ndarray, count: np.ndarray, idx: np.ndarray, size: np.ndarray, base: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(3, replicate): mass of positives, of negatives, and positives above negatives (ties one half) of one bucket."""
    order = np.argsort(score, kind="stable")
    score, positive, count, idx = score[order], positive[order], count[order].astype(float), idx[order]
    starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    out = np.zeros((3, len(reps)))
    step = max(1, CELLS // max(len(score), 1))
    drawn = {}
    for cls in (True, False):
        mine = np.flatnonzero(positive == cls)
        groups, at = np.unique(idx[mine], return_inverse=True)
        drawn[cls] = (mine, groups, at, int(size[order][mine[0]]) if len(mine) else 0, int(base[order][mine[0]]) if len(mine) else 0)
    for low in range(0, len(reps), step):
        r, mass = reps[low : low + step], {}
        for cls, (mine, groups, at, n, b) in drawn.items():
            m = np.zeros((len(score), len(r)))
            if len(mine):
                m[mine] = multiplicities(b, n, r, groups)[at] * count[mine, None]
            mass[cls] = np.add.reduceat(m, starts, axis=0)
        below = np.cumsum(mass[False], axis=0) - 0.5 * mass[False]
        out[:, low : low + step] = mass[True].sum(axis=0), mass[False].sum(axis=0), (mass[True] * below).sum(axis=0)
    return out


def indexed(rows: DataFrame, within: Sequence[str], group: str, seed: int) -> DataFrame:
    """Per (within, group): its position ``idx``, the number of groups ``idx_count``, and the seed ``_base`` of the draws."""
    out = folds.dense_index(rows, group, within)
    return out.withColumn("_base", folds.hash_number(seed, *[F.col(c) for c in within]).bitwiseAND(F.lit(BITS)))


def _blocks(bucketed: bool, n_boot: int) -> Column:
    """Blocks of replicates: several where one bucket is all there is, so that more than one task works on it."""
    return F.explode(F.sequence(F.lit(0), F.lit(0 if bucketed else min(REP_BLOCKS, n_boot) - 1)))


def _reps(block: int, bucketed: bool, n_boot: int) -> np.ndarray:
    return np.array_split(np.arange(n_boot), 1 if bucketed else min(REP_BLOCKS, n_boot))[block]


def auc(rows: DataFrame, keys: Sequence[str], group: str, score: str, index: DataFrame, n_boot: int) -> DataFrame:
    """AUC per (keys, rep). ``rows`` has ``_cls`` ('pos' or 'neg'); ``index`` comes from ``indexed`` within (keys, class)."""
    keys = list(keys)
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*keys, "_cls", group, score).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.join(index, [*keys, "_cls", group]).select(*keys, "_cls", F.col(score).cast("double").alias("_score"), "_n", "idx", "idx_count", "_base")
    placed = ordered.range_bucket(counts, "_score", keys)
    bucketed = ordered.BUCKET in placed.columns
    placed = placed if bucketed else placed.withColumn(ordered.BUCKET, F.lit(0))
    placed = placed.withColumn("_block", _blocks(bucketed, n_boot))
    fields = {f.name: f.dataType.simpleString() for f in placed.schema}

    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = _reps(int(pdf["_block"].iloc[0]), bucketed, n_boot)
        pos = pdf["_cls"].to_numpy() == "pos"
        p, q, a = bucket_sums(pdf["_score"].to_numpy(), pos, pdf["_n"].to_numpy(), pdf["idx"].to_numpy(), pdf["idx_count"].to_numpy(), pdf["_base"].to_numpy(), reps)
        own = {k: [pdf[k].iloc[0]] * len(reps) for k in keys}
        return pd.DataFrame({**own, ordered.BUCKET: pdf[ordered.BUCKET].iloc[0], "rep": reps, "_p": p, "_q": q, "_a": a})

    schema = "".join(f"{k} {fields[k]}, " for k in keys) + f"{ordered.BUCKET} int, rep int, _p double, _q double, _a double"
    sums = placed.groupBy(*keys, ordered.BUCKET, "_block").applyInPandas(vectors, schema)
    if bucketed:
        # replicates times buckets rows
        lower = Window.partitionBy(*keys, "rep").orderBy(ordered.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_a", F.col("_a") + F.col("_p") * F.coalesce(F.sum("_q").over(lower), F.lit(0.0)))
    total = sums.groupBy(*keys, "rep").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.sum("_a").alias("_a"))
    return total.select(*keys, "rep", F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_a") / (F.col("_p") * F.col("_q"))).alias(score))


def ratio(rows: DataFrame, keys: Sequence[str], group: str, top: str, bottom: str, n_boot: int, seed: int, name: str) -> DataFrame:
    """Per (keys, rep): sum of ``top`` over sum of ``bottom`` of the drawn groups; one row a group in ``rows``."""
    keys = list(keys)
    placed = rows.join(indexed(rows, keys, group, seed), [*keys, group]).withColumn("_part", F.floor(F.col("idx") / GROUP_BLOCK).cast("int"))
    placed = placed.withColumn("_block", _blocks(False, n_boot)).select(*keys, "_part", "_block", "idx", "idx_count", "_base", F.col(top).cast("double").alias("_t"), F.col(bottom).cast("double").alias("_b"))
    fields = {f.name: f.dataType.simpleString() for f in placed.schema}

    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, sums = _reps(int(pdf["_block"].iloc[0]), False, n_boot), []
        values = pdf[["_t", "_b"]].to_numpy().T
        step = max(1, CELLS // len(pdf))
        for low in range(0, len(reps), step):
            sums.append(values @ multiplicities(int(pdf["_base"].iloc[0]), int(pdf["idx_count"].iloc[0]), reps[low : low + step], pdf["idx"].to_numpy()))
        t, b = np.concatenate(sums, axis=1)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(reps) for k in keys}, "rep": reps, "_t": t, "_b": b})

    schema = "".join(f"{k} {fields[k]}, " for k in keys) + "rep int, _t double, _b double"
    sums = placed.groupBy(*keys, "_part", "_block").applyInPandas(vectors, schema)
    return sums.groupBy(*keys, "rep").agg((F.sum("_t") / F.sum("_b")).alias(name))
