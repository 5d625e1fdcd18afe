"""Scores of probability tables: AUC slices, threshold metrics, calibration quality, selection criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ordered

DECISION_THRESHOLD = 0.5


def share(flag: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(flag.cast("double"))


def auc_against(
    df: DataFrame, score: str, positive: Column, stratum: str | Column, name: str = "auc"
) -> DataFrame:
    """AUC of all positives against each stratum of the other rows.

    Positives are ordered once and looked up by score, not copied per stratum.
    """
    stratum = F.col(stratum) if isinstance(stratum, str) else stratum
    above = ordered.value_counts(df, [], score, {"_p": F.sum(F.when(positive, 1.0).otherwise(0.0))})
    above = ordered.scan(ordered.range_bucket(above, score), [], [score], {"_cum": F.col("_p")}, {"_total": "_cum"})
    above = above.select(score, "_p", "_cum", "_total")
    rest = (
        df.filter(~positive & stratum.isNotNull() & F.col(score).isNotNull())
        .groupBy(stratum.alias("stratum"), score)
        .agg(F.count(F.lit(1)).alias("_q"))
    )
    won = rest.join(above, score)
    beaten = F.col("_total") - F.col("_cum") + 0.5 * F.col("_p")
    area = F.sum(F.col("_q") * beaten) / F.when(F.max("_total") > 0, F.max("_total") * F.sum("_q"))
    return won.groupBy("stratum").agg(F.sum("_q").alias("n"), area.alias(name))


def points(auc: Column, weight: float) -> Column:
    """``weight`` points for an AUC of 1, none at or below chance."""
    return F.lit(weight) * F.greatest(F.lit(0.0), (auc - 0.5) / 0.5)


def false_positive_mean(groups: Sequence[Column], score: str) -> Column:
    """Mean false-positive share over the groups that have rows, 0 if none has."""
    hit = F.col(score) >= DECISION_THRESHOLD
    shares = F.array(*[share(F.when(g, hit)) for g in groups])
    present = F.filter(shares, lambda s: s.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, s: a + s) / F.size(present)
    return F.when(F.size(present) > 0, mean).otherwise(0.0)


def selection_score(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, negative: Column, groups: Sequence[Column], name: str
) -> DataFrame:
    """30 points for the AUC against ``negative`` plus 20 for the mean specificity of ``groups``."""
    label = F.when(positive, True).when(negative, False)
    area = ordered.auc(df, keys, score, label, name="_auc")
    fpr = df.groupBy(*keys).agg(false_positive_mean(groups, score).alias("_fpr"))
    both = area.join(fpr, list(keys)) if keys else area.crossJoin(F.broadcast(fpr))
    return both.select(*keys, (points(F.col("_auc"), 30.0) + 20.0 * (1.0 - F.col("_fpr"))).alias(name))


def selection_score_two_aucs(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, control: Column, specific: Column, name: str
) -> DataFrame:
    """Threshold-free criterion: 30 points against controls, 20 against the specificity strata."""
    both = ordered.aucs(df, keys, score, positive, {"_a": control, "_b": specific})
    return both.select(*keys, (points(F.col("_a"), 30.0) + points(F.col("_b"), 20.0)).alias(name))


def threshold_metrics(df: DataFrame, score: str, positive: Column, control: Column, stratum: str) -> DataFrame:
    """Sensitivity, balanced accuracies and per-stratum specificity in one grouping-sets pass."""
    hit, miss = F.col(score) >= DECISION_THRESHOLD, F.col(score) < DECISION_THRESHOLD
    base = df.select(
        F.col(stratum).alias("stratum"),
        F.when(positive, hit).alias("_sens"),
        F.when(~positive, miss).alias("_spec"),
        F.when(control, miss).alias("_ctrl"),
    )
    sens, spec, ctrl = share(F.col("_sens")), share(F.col("_spec")), share(F.col("_ctrl"))
    table = base.rollup("stratum").agg(
        F.grouping("stratum").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        (0.5 * (sens + ctrl)).alias("balanced_vs_controls"),
        (0.5 * (sens + spec)).alias("balanced_vs_all"),
    )
    return table.withColumn("stratum", F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col("stratum"))).drop("_all")


def brier_and_log_loss(df: DataFrame, keys: Sequence[str], score: str, label: Column) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = label.cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
    )


def reliability(df: DataFrame, score: str, label: Column, n_bins: int = 5) -> DataFrame:
    """Mean predicted probability and observed rate in right-closed quantile bins with unique edges."""
    names = [f"_e{i}" for i in range(n_bins + 1)]
    edges = ordered.quantiles(df, [], score, {n: i / n_bins for i, n in enumerate(names)})
    edges = edges.select(F.array_sort(F.array_distinct(F.array(*names))).alias("_edges"))
    placed = df.crossJoin(F.broadcast(edges))  # one row of n_bins + 1 numbers
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bin_of = F.size(F.filter(inner, lambda e: e < F.col(score)))
    return (
        placed.withColumn("bin", bin_of)
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_p"),
            F.avg(label.cast("double")).alias("observed"),
        )
    )


def equal_error_shift(
    df: DataFrame, logit: str, positive: Column, negative: Column, name: str = "shift", keys: Sequence[str] = ()
) -> DataFrame:
    """Threshold per key where sensitivity equals specificity: median of the cuts with the smallest gap.

    Cuts are the midpoints between neighbouring distinct logits and one beyond each end. Keys without one of the classes are absent.
    """
    keys = list(keys)
    kept = df.filter(positive | negative)
    counts = ordered.value_counts(
        kept, keys, logit, {"_p": F.sum(positive.cast("double")), "_q": F.sum(negative.cast("double"))}
    )
    counts = ordered.scan(
        ordered.range_bucket(counts, logit, keys),
        keys,
        [logit],
        {"_cp": F.col("_p"), "_cq": F.col("_q")},
        {"_np": "_cp", "_nq": "_cq"},
        following={"_next": logit},
    )
    cut = F.when(F.col("_next").isNull(), F.col(logit) + 1.0).otherwise((F.col(logit) + F.col("_next")) / 2.0)
    both = (F.col("_np") > 0) & (F.col("_nq") > 0)
    gap = F.when(both, F.abs((F.col("_np") - F.col("_cp")) / F.col("_np") - F.col("_cq") / F.col("_nq")))
    cuts = counts.select(*keys, cut.alias("cut"), gap.alias("gap")).filter("gap IS NOT NULL")
    below = kept.groupBy(*keys).agg((F.min(logit) - 1.0).alias("cut"), F.count_if(positive).alias("_np"), F.count_if(negative).alias("_nq"))
    cuts = cuts.unionByName(below.filter(both).select(*keys, "cut", F.lit(1.0).alias("gap")))
    best = cuts.groupBy(*keys).agg(F.min("gap").alias("_best"))
    both = cuts.join(best, keys) if keys else cuts.crossJoin(F.broadcast(best))
    near = both.filter(F.col("gap") - F.col("_best") <= 1e-8 + 1e-5 * F.col("_best"))
    return ordered.median(near, keys, "cut", name)


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One ROC point per distinct threshold: share of positives and negatives at or above it."""
    counts = ordered.value_counts(
        df, [], score, {"_p": F.sum(positive.cast("double")), "_q": F.sum((~positive).cast("double"))}
    )
    counts = ordered.scan(
        ordered.range_bucket(counts, score),
        [],
        [score],
        {"_cp": F.col("_p"), "_cq": F.col("_q")},
        {"_np": "_cp", "_nq": "_cq"},
    )
    return counts.select(
        F.col(score).alias("threshold"),
        ((F.col("_np") - F.col("_cp") + F.col("_p")) / F.col("_np")).alias("tpr"),
        ((F.col("_nq") - F.col("_cq") + F.col("_q")) / F.col("_nq")).alias("fpr"),
    )


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Rank correlation per key with average ranks for ties."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # the pair table keeps one row per distinct (a, b) pair, weighted by its count
    pairs, _ = ordered.settle(both.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    out = pairs
    for col, rank in ((a, "_ra"), (b, "_rb")):
        counts = ordered.value_counts(pairs, keys, col, {"_n": F.sum("_w")})
        counts = ordered.scan(ordered.range_bucket(counts, col, keys), keys, [col], {"_cum": F.col("_n")})
        counts = counts.select(*keys, col, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(rank))
        out = out.join(counts, [*keys, col])
    pairs = out
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    n = F.sum(w)
    cov = F.sum(w * x * y) / n - F.sum(w * x) / n * F.sum(w * y) / n
    vx = F.sum(w * x * x) / n - F.pow(F.sum(w * x) / n, 2)
    vy = F.sum(w * y * y) / n - F.pow(F.sum(w * y) / n, 2)
    return pairs.groupBy(*keys).agg(n.cast("long").alias("n"), (cov / F.sqrt(vx * vy)).alias(name))
