"""Leave-one-group-out, group bootstrap and permutation, with hash-derived draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import folds, ordered, replicates
from sigloom.session import checkpointed

N_BOOTSTRAP = 2000
CI = {"ci_low": 0.025, "ci_high": 0.975}


def leave_group_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of all other groups, as total minus own: no pairing of groups."""
    own = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = own.agg(F.sum("_s").alias("_S"), F.sum("_n").alias("_N"))  # one row
    joined = own.toDF(group, "_s0", "_n0").crossJoin(F.broadcast(total.toDF("_s1", "_n1")))
    rest = (F.col("_s1") - F.col("_s0")) / (F.col("_n1") - F.col("_n0"))
    return joined.select(group, F.col("_n0").alias("n_test"), (F.col("_n1") - F.col("_n0")).alias("n_train"), rest.alias("train_mean"))


def bootstrap_auc(
    df: DataFrame, keys: Sequence[str], group: str, scores: Sequence[str], positive: Column, n_boot: int = N_BOOTSTRAP, seed: int = 42
) -> DataFrame:
    """AUC per (keys, rep) for each score under one class-stratified group bootstrap.

    Every replicate draws as many groups of a class as there are, with replacement; draw j of replicate b is a hash of
    (seed, keys, class, b, j). Rows collapse to (class, group, score) counts before tasks turn them into replicate vectors.
    """
    keys = list(keys)
    rows = df.filter(positive.isNotNull()).withColumn("_cls", F.when(positive, "pos").otherwise("neg"))
    index = checkpointed(replicates.indexed(rows.select(*keys, "_cls", group), [*keys, "_cls"], group, seed))
    out = None
    for score in scores:
        area = replicates.auc(rows, keys, group, score, index, n_boot)
        out = area if out is None else out.join(area, [*keys, "rep"])
    return out


def interval(reps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Percentile interval over replicates."""
    return ordered.quantiles(reps, keys, value, CI)


def auc_with_ci(df: DataFrame, keys: Sequence[str], group: str, score: str, positive: Column, n_boot: int = N_BOOTSTRAP, seed: int = 42) -> DataFrame:
    """AUC with a group-bootstrap percentile interval per key."""
    keys = list(keys)
    value = ordered.auc(df, keys, score, positive, name="value")
    ci = interval(bootstrap_auc(df, keys, group, [score], positive, n_boot, seed), keys, score)
    return value.join(ci, keys) if keys else value.crossJoin(F.broadcast(ci))


def rate_with_ci(df: DataFrame, keys: Sequence[str], group: str, hit: Column, n_boot: int = N_BOOTSTRAP, seed: int = 42) -> DataFrame:
    """Share of hits with a group-bootstrap percentile interval per key."""
    keys = list(keys)
    rows = df.groupBy(*keys, group).agg(F.sum(hit.cast("double")).alias("_h"), F.count(hit).alias("_n"))
    rows = checkpointed(rows)
    value = rows.groupBy(*keys).agg((F.sum("_h") / F.sum("_n")).alias("value"))
    ci = interval(replicates.ratio(rows, keys, group, "_h", "_n", n_boot, seed, "_r"), keys, "_r")
    return value.join(ci, keys) if keys else value.crossJoin(F.broadcast(ci))


def paired_auc_difference(
    df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, positive: Column, n_boot: int = N_BOOTSTRAP, seed: int = 42
) -> DataFrame:
    """AUC(a) - AUC(b) on the same rows and the same resamples."""
    keys = list(keys)
    va, vb = ordered.auc(df, keys, a, positive, name="_a"), ordered.auc(df, keys, b, positive, name="_b")
    value = (va.join(vb, keys) if keys else va.crossJoin(F.broadcast(vb))).select(*keys, (F.col("_a") - F.col("_b")).alias("value"))
    reps = bootstrap_auc(df, keys, group, [a, b], positive, n_boot, seed)
    ci = interval(reps.withColumn("_d", F.col(a) - F.col(b)), keys, "_d")
    return value.join(ci, keys) if keys else value.crossJoin(F.broadcast(ci))


def permuted_labels(df: DataFrame, group: str, row: str, labels: Sequence[str], n_perm: int, seed: int = 42, inside: Column | None = None) -> DataFrame:
    """Labels moved between groups: (perm, group, labels) for ``n_perm`` seeded permutations.

    A group receives the label tuple of the first row of its donor. With ``inside`` only rows that satisfy it
    take part, and only groups having such rows are permuted.
    """
    rows = df if inside is None else df.filter(inside)
    first = df.join(rows.select(group).distinct(), group, "left_semi").groupBy(group).agg(F.min_by(F.struct(*labels), row).alias("_l"))
    seats = folds.dense_index(first, group)
    perms = first.select(group, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    donors = folds.shuffled_index(perms, group, F.concat_ws("-", F.lit(str(seed)), F.col("perm").cast("string")), ["perm"])
    donors = donors.join(first, group).select("perm", "idx", "_l")
    moved = seats.select(group, "idx").join(donors, "idx")
    return moved.select("perm", group, *[F.col(f"_l.{c}").alias(c) for c in labels])


def permutation_p(observed: Column, null: Column, direction: int = 1) -> Column:
    """Aggregate: one-sided p = (1 + number at least as extreme) / (1 + n)."""
    extreme = null >= observed if direction > 0 else null <= observed
    return (1 + F.count_if(extreme)) / (1 + F.count(null))


def specificity_verdict(pc: Column, pc_lo: Column, pc_hi: Column, sc: Column, ps_lo: Column, ps_hi: Column) -> Column:
    """Label of a feature from three AUCs: case/control, other/control, case/other."""
    shift = lambda lo, hi: (lo > 0.5) | (hi < 0.5)
    shared = shift(pc_lo, pc_hi) & ((pc - 0.5) * (sc - 0.5) > 0) & (F.abs(sc - 0.5) >= 0.5 * F.abs(pc - 0.5))
    return F.when(shared, "shared with somatoform").when(shift(pc_lo, pc_hi) | shift(ps_lo, ps_hi), "specific to PTSD").otherwise("no difference")
