"""Evaluation jobs around the nested procedure: controls, repeated folds, held-out batches, permutations, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import folds, learn, metrics, nested, ordered, permutations, resample
from sigloom.session import checkpointed

FORMAT_B = (strata.CONTROL_B, strata.CONTROL_B_SUPPLEMENT, strata.AGEING)
AGE_RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def fixed_oof(df: DataFrame, features: Sequence[str], c: float = 1.0, scale: bool = True, limit: int = nested.BROADCAST_BYTES) -> DataFrame:
    """Leave-one-group-out probabilities of one fixed logistic model, with or without scaling."""
    names = tuple(features)
    protocol = nested.Protocol("fixed", {"all": names}, (nested.Candidate(c, "control+somatoform", "all"),), calibrate=False)
    rows = checkpointed(df.withColumns({"outer": F.col("grp").cast("long"), "fold": F.lit(0)}))
    keep = ("row", "grp", "stratum", "y")
    if not nested.fits_in_broadcast(rows, protocol, limit):
        chosen = rows.select("outer").distinct().withColumn("candidate", F.lit(0))
        out = nested._outer_predictions(rows, chosen, protocol, (), limit, scale)
        return out.join(rows.select(*keep), "row").select(*keep, F.col("p_raw").alias("p"))
    shared = rows.sparkSession.sparkContext.broadcast(nested._matrix(rows, protocol))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for block in blocks:
            for o in block["outer"]:
                train, test = np.flatnonzero(m.outer != o), np.flatnonzero(m.outer == o)
                if scale:
                    p = next(m.fit_predict(train, test, names, [c], 1.0))
                else:
                    y = m.y[train]
                    w = np.where(y == 1, y.size / (2 * y.sum()), y.size / (2 * (y.size - y.sum())))
                    beta = learn.solve_local(m.x[train], y, w, c)
                    p = 1 / (1 + np.exp(-(m.x[test] @ beta[:-1] + beta[-1])))
                yield pd.DataFrame({"row": m.row[test], "p": p})

    out = rows.select("outer").distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism, "outer").mapInPandas(run, "row long, p double")
    return out.join(rows.select(*keep), "row").select(*keep, "p")


def ridge_oof(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = AGE_RIDGE_ALPHAS, limit: int = nested.BROADCAST_BYTES) -> DataFrame:
    """Leave-one-group-out ridge prediction of a number and the training mean; alpha by leave-one-out error.

    Median-filled features. Every training set is the total minus one group, so the normal equations of all folds
    come from one pass of per-group sums; only the leave-one-out error of each alpha visits rows again.
    """
    stats = learn.feature_table(df, features)
    p = len(features)
    filled = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(stats[n][0])) - F.lit(stats[n][1]) for n in features]
    rows = checkpointed(df.filter(F.col(target).isNotNull()).select("row", F.col("grp").cast("long").alias("grp"), F.col(target).cast("double").alias("t"), F.array(*filled).alias("x")))

    def moments(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for g, part in block.groupby("grp"):
                x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part)), part["t"]])
                yield pd.DataFrame({"grp": g, "pos": np.arange((p + 2) ** 2), "v": (x.T @ x).ravel()})

    sums = rows.select("grp", "t", "x").mapInPandas(moments, "grp long, pos int, v double").groupBy("grp", "pos").agg(F.sum("v").alias("v"))
    total = sums.groupBy("pos").agg(F.sum("v").alias("all"))
    packed = sums.join(total, "pos").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("all") - F.col("v")).alias("v")))), lambda s: s["v"]).alias("m"))

    def solve(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Ridge on centred, scaled features from the moment matrix of one training set."""
        m = m.reshape(p + 2, p + 2)
        n, mean, mt = m[p, p], m[p, :p] / m[p, p], m[p, p + 1] / m[p, p]
        cov = m[:p, :p] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
        sd = np.where(sd > 0, sd, 1.0)
        inner = np.linalg.inv(cov / np.outer(sd, sd) + alpha * np.eye(p))
        return inner, inner @ ((m[:p, p + 1] - n * mean * mt) / sd), mean, sd, (mt, n)

    # folds travel as one small array each, in blocks of at most `limit` bytes
    blocks = max(1, -(-packed.count() * (p + 2) ** 2 * 8 // limit))
    packed = checkpointed(packed.withColumn("block", F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int")))
    return reduce(DataFrame.unionByName, [_ridge_block(rows, packed.filter(F.col("block") == b), p, alphas, solve) for b in range(blocks)])


def _ridge_block(rows: DataFrame, packed: DataFrame, p: int, alphas: Sequence[float], solve: Callable) -> DataFrame:
    """Leave-one-out error of every (fold, alpha) of one block over the rows of all other groups, then the predictions."""
    moments = {r["grp"]: np.array(r["m"]) for r in packed.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(moments)

    def errors(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {(g, a): solve(m, a) for g, m in shared.value.items() for a in alphas}
        sse = dict.fromkeys(found, 0.0)
        for block in blocks:
            x, t, own = np.stack(block["x"].to_numpy()) if len(block) else np.zeros((0, p)), block["t"].to_numpy(), block["grp"].to_numpy()
            for (g, a), (inner, coef, mean, sd, (mt, n)) in found.items():
                z = (x[own != g] - mean) / sd
                lever = 1 / n + np.einsum("ij,jk,ik->i", z, inner, z)
                sse[g, a] += float((((t[own != g] - mt - z @ coef) / (1 - lever)) ** 2).sum())
        yield pd.DataFrame([(g, a, v) for (g, a), v in sse.items()], columns=["grp", "alpha", "sse"])

    loo = rows.select("grp", "t", "x").mapInPandas(errors, "grp long, alpha double, sse double").groupBy("grp", "alpha").agg(F.sum("sse").alias("sse"))
    best = loo.groupBy("grp").agg(F.min_by("alpha", F.struct("sse", "alpha")).alias("alpha"))

    def predict(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for (g, alpha), part in block.groupby(["grp", "alpha"]):
                _, coef, mean, sd, (mt, _) = solve(shared.value[g], alpha)
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame({"row": part["row"], "target": part["t"], "predicted": mt + (x - mean) / sd @ coef, "reference": mt})

    return rows.join(best, "grp").mapInPandas(predict, "row long, target double, predicted double, reference double")


def fold_aucs(df: DataFrame, protocol: nested.Protocol, comparisons: dict[str, Sequence[str]], n_splits: int = 5, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """AUC inside the test folds of repeated grouped, stratified K-fold runs of the whole procedure."""
    parts = []
    s = F.col("stratum")
    df = checkpointed(df)  # every repeat starts from this table, so what is behind it is computed once
    for r in range(n_repeats):
        cut = folds.stratified_group_folds(df, "grp", "stratum", n_splits, seed + r, "test_fold")
        oof = checkpointed(nested.nested_oof(df.join(cut, "grp"), protocol, outer="test_fold"))
        table = oof.groupBy(F.col("outer").alias("fold")).agg(F.min("candidate").alias("candidate"))
        for name, negatives in comparisons.items():
            area = ordered.auc(oof, ["outer"], "p", F.when(s == strata.PTSD, True).when(s.isin(*negatives), False), name=name)
            table = table.join(area.withColumnRenamed("outer", "fold"), "fold", "left")
        parts.append(table.withColumn("repeat", F.lit(r)))
    return reduce(DataFrame.unionByName, parts)


def unseen_batch(df: DataFrame, protocol: nested.Protocol, reference: DataFrame, held_out: str, n_boot: int = resample.N_BOOTSTRAP) -> DataFrame:
    """AUC of cases against one stratum left out of the whole procedure, next to its in-training value."""
    s = F.col("stratum")
    train = checkpointed(df.filter(s != held_out))
    oof = nested.nested_oof(train, protocol)
    model, _ = nested.train_final(train, protocol)
    out = df.filter(s == held_out).select("row", "grp", "stratum", model.probability_raw().alias("p_raw"), model.probability().alias("p"))
    cases = oof.filter(s == strata.PTSD).select("row", "grp", "stratum", "p_raw", "p")
    both = checkpointed(cases.unionByName(out))
    unseen = resample.auc_with_ci(both, [], "grp", "p_raw", s == strata.PTSD, n_boot)
    unseen = unseen.select(F.col("value").alias("auc_unseen"), F.col("ci_low").alias("auc_unseen_ci_low"), F.col("ci_high").alias("auc_unseen_ci_high"))
    before = ordered.auc(reference, [], "p_raw", F.when(s == strata.PTSD, True).when(s == held_out, False), name="auc_in_training")
    hit = F.col("p") >= metrics.DECISION_THRESHOLD
    now = both.filter(s == held_out).agg(F.count(F.lit(1)).alias("n"), metrics.share(hit).alias("share_p_ge_05_unseen"))
    then = reference.filter(s == held_out).agg(metrics.share(hit).alias("share_p_ge_05_in_training"))
    return now.crossJoin(unseen).crossJoin(before).crossJoin(then)  # four one-row tables


def permutation_test(
    df: DataFrame, protocol: nested.Protocol, observed: float, n_perm: int, negatives: Column, score: str = "p", inside: Column | None = None, seed: int = 42
) -> DataFrame:
    """Null distribution of the nested AUC when (label, stratum) pairs move between groups, and its p-value.

    With ``inside`` only rows satisfying it are permuted. Every permutation reruns the whole procedure; all of them are one job.
    """
    return permutations.summary(permutations.null_distribution(df, protocol, n_perm, negatives, score, inside, seed), observed)


def within_format_b(stratum: Column) -> Column:
    return stratum.isin(strata.PTSD, *FORMAT_B)


def slices(stratum: Column) -> dict[str, Column]:
    """Negatives of the standard report."""
    return {
        "controls_excl_ageing": stratum.startswith("control_") & (stratum != strata.AGEING),
        "controls_AB": stratum.isin(strata.CONTROL_A, strata.CONTROL_B, strata.CONTROL_B_SUPPLEMENT),
        "all_controls": stratum.startswith("control_"),
        "all_non_ptsd": stratum != strata.PTSD,
        "ageing_and_somatoform": stratum.isin(*strata.SPECIFICITY_STRATA),
    }


def report(oof: DataFrame, score: str = "p", n_boot: int = resample.N_BOOTSTRAP) -> dict[str, DataFrame]:
    """Report tables of out-of-fold probabilities: AUC slices with intervals, strata, thresholds, calibration, candidates."""
    oof = checkpointed(oof)
    s = F.col("stratum")
    case = s == strata.PTSD
    # one row can belong to several slices; cases belong to all
    tags = F.array_compact(F.array(*[F.when(case | negative, F.lit(name)) for name, negative in slices(s).items()]))
    sliced = oof.select("grp", score, case.alias("case"), F.explode(tags).alias("slice"))
    specific = oof.filter(~case)
    spec = resample.rate_with_ci(specific, ["stratum"], "grp", F.col(score) >= metrics.DECISION_THRESHOLD, n_boot)
    out = {
        "auc": resample.auc_with_ci(sliced, ["slice"], "grp", score, F.col("case"), n_boot),
        "auc_by_stratum": metrics.auc_against(oof, score, case, "stratum"),
        "specificity": spec.select("stratum", (1 - F.col("value")).alias("value"), (1 - F.col("ci_high")).alias("ci_low"), (1 - F.col("ci_low")).alias("ci_high")),
        "threshold": metrics.threshold_metrics(oof, score, case, s.isin(strata.CONTROL_A, strata.CONTROL_B, strata.CONTROL_B_SUPPLEMENT), "stratum"),
        "median_p": ordered.median(oof, ["stratum"], score, "median_p"),
        "quality": metrics.brier_and_log_loss(oof, [], score, case),
        "reliability": metrics.reliability(oof, score, case),
    }
    if "candidate" in oof.columns:
        out["candidates"] = nested.candidate_frequency(oof)
    if "cal_a" in oof.columns:
        per_fold = oof.filter("cal_a IS NOT NULL").groupBy("outer").agg(F.min("cal_a").alias("cal_a"), F.min("cal_b").alias("cal_b"))
        mid = ordered.median(per_fold, [], "cal_a", "a_median").crossJoin(ordered.median(per_fold, [], "cal_b", "b_median"))
        out["calibration"] = mid.crossJoin(per_fold.agg(F.min("cal_a").alias("a_min"), F.max("cal_a").alias("a_max")))
    return out


# Bands [lo, hi) of the report
AGE_BANDS = (("17-29", 0.0, 30.0), ("30-45", 30.0, 46.0), ("46-64", 46.0, 65.0), ("65+", 65.0, float("inf")))


def by_age_band(oof: DataFrame, score: str = "p", bands: Sequence[tuple[str, float, float]] = AGE_BANDS) -> DataFrame:
    """Per age band of the others: size, median score, specificity, and the area of all cases against the band."""
    case, band = F.col("stratum") == strata.PTSD, F.lit(None).cast("string")
    for name, lo, hi in bands:
        band = F.when((F.col("age") >= lo) & (F.col("age") < hi), name).otherwise(band)
    rest = oof.filter(~case).withColumn("band", band)
    per = rest.groupBy("band").agg(F.count(score).alias("n"), metrics.share(F.col(score) < metrics.DECISION_THRESHOLD).alias("specificity"))
    area = metrics.auc_against(oof, score, case, band, "auc").select(F.col("stratum").alias("band"), "auc")
    names = oof.sparkSession.createDataFrame([(b,) for b, _, _ in bands], "band string")
    out = names.join(per, "band", "left").join(ordered.median(rest.filter("band IS NOT NULL"), ["band"], score, "median_p"), "band", "left").join(area, "band", "left")
    return out.select("band", F.coalesce("n", F.lit(0)).alias("n"), "median_p", "specificity", "auc")


def history(reports: dict[str, DataFrame]) -> DataFrame:
    """Areas of several runs in one table: (run, slice, value, ci_low, ci_high)."""
    parts = [t.select(F.lit(name).alias("run"), "slice", "value", "ci_low", "ci_high") for name, t in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def restricted_runs(df: DataFrame, protocol: nested.Protocol) -> DataFrame:
    """Ablation: the nested AUC against controls with each feature set alone."""
    s = F.col("stratum")
    parts = []
    for name in protocol.feature_sets:
        oof = nested.nested_oof(df, nested.restricted(protocol, [name], f"{protocol.name}:{name}"))
        area = ordered.auc(oof, [], "p_raw", F.when(s == strata.PTSD, True).when(slices(s)["controls_excl_ageing"], False))
        parts.append(area.withColumn("feature_set", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def criterion_free(protocol: nested.Protocol, controls: Sequence[str]) -> nested.Protocol:
    """Protocol variant whose criterion weighs controls and specificity strata without thresholds."""
    return replace(protocol, controls=tuple(controls), threshold_free=True)
