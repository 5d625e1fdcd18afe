"""Task branch and two-branch model: populations, selection of C alone, reports, final fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import features, learn, metrics, nested, ordered, protocols, resample, spectral
from sigloom.session import checkpointed

# Names of the feature lists and of the files' populations
TRIAL1_BEHAVIOUR = ("beh_log_duration_trial1",)
TRIAL1_EEG = tuple(f"eeg_{kind}_{band}_{ch}" for kind in ("trial1", "react1") for band in spectral.BANDS_20 for ch in features.TASK_CHANNELS)
DYNAMICS_BEHAVIOUR = ("beh_log_duration_mean", "beh_log_duration_slope", "beh_first_trial_excess")
DYNAMICS_EEG = ("eeg_slope_alpha_O1", "eeg_slope_theta_Fp")
REST_EEG = protocols.PROTOCOLS["protocol3"].procedure.feature_sets["rest20"]
PLAN = {
    "trial1": {"behaviour": TRIAL1_BEHAVIOUR, "eeg": TRIAL1_EEG, "combined": TRIAL1_BEHAVIOUR + TRIAL1_EEG},
    "trial1_eeg_with_format_C": {"eeg": TRIAL1_EEG},
    "dynamics": {"behaviour": DYNAMICS_BEHAVIOUR, "eeg": DYNAMICS_EEG, "combined": DYNAMICS_BEHAVIOUR + DYNAMICS_EEG},
}
TWO_BRANCHES = {"behaviour": TRIAL1_BEHAVIOUR, "rest_eeg": REST_EEG, "combined": TRIAL1_BEHAVIOUR + REST_EEG}
SUBMITTED = "combined"
CONTROLS = (strata.CONTROL_A, strata.CONTROL_B)


def procedure(name: str, names: Sequence[str], two_aucs: bool = False, c_grid: Sequence[float] = nested.C_GRID) -> nested.Protocol:
    """Selection of C alone on one feature list: by the area against all others, or by the two weighted areas."""
    return nested.Protocol(
        name, {"all": tuple(names)}, tuple(nested.Candidate(c, "control+somatoform", "all") for c in c_grid), CONTROLS, (strata.SPECIFICITY_STRATA,),
        calibration_balanced=False, equal_error=False, all_negatives=not two_aucs, ordered_choice=True,
    )


def populations(subjects: DataFrame, task: DataFrame) -> dict[str, DataFrame]:
    """Rows of protocol 4: subjects with task files and the task features, as the nested procedure takes them."""
    rows = subjects.filter("has_task_files").join(task, "subject_key").withColumnsRenamed({"label": "y", "split_group": "grp"})
    rows = rows.withColumn("row", F.xxhash64("subject_key"))
    solved, other_format = F.col("beh_log_duration_trial1").isNotNull(), F.col("export_family") == "C"
    whole = F.lit(True)
    for n in DYNAMICS_BEHAVIOUR:
        whole = whole & F.col(n).isNotNull()
    format_c = F.coalesce(other_format, F.lit(False))
    return {"trial1": rows.filter(~format_c & solved), "trial1_eeg_with_format_C": rows.filter(solved | format_c), "dynamics": rows.filter(~format_c & whole & ~F.col("holdout"))}


def two_branch_population(subjects: DataFrame, rest: DataFrame, task: DataFrame) -> DataFrame:
    """Rows of protocol 5: the trial population with resting features beside those of the task."""
    return populations(subjects, task)["trial1"].join(rest.select("subject_key", *REST_EEG), "subject_key", "left")


def oofs(population: DataFrame, models: dict[str, Sequence[str]], two_aucs: bool = False, limit: int = nested.BROADCAST_BYTES) -> dict[str, DataFrame]:
    """Nested out-of-fold rows of every model of one population."""
    rows = checkpointed(population)
    return {name: checkpointed(nested.nested_oof(rows, procedure(name, names, two_aucs), limit=limit)) for name, names in models.items()}


def _scored(found: dict[str, DataFrame]) -> DataFrame:
    """All models in one table: model, score (p or p_raw), value."""
    out = None
    for name, oof in found.items():
        both = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in ("p_raw", "p")])).alias("s")
        part = oof.select(F.lit(name).alias("model"), "row", "grp", "stratum", "y", both).select("model", "row", "grp", "stratum", "y", "s.*")
        out = part if out is None else out.unionByName(part)
    return checkpointed(out)


def report(found: dict[str, DataFrame], differences: Sequence[tuple[str, str]], two_aucs: bool = False, n_boot: int = resample.N_BOOTSTRAP) -> dict[str, DataFrame]:
    """Report tables per model and score: areas with intervals, areas and specificity per stratum, threshold metrics, C per fold."""
    rows, keys = _scored(found), ["model", "score"]
    case, s = F.col("y") == 1, F.col("stratum")
    slices: dict[str, Column] = {"all_non_ptsd": ~case}
    if two_aucs:
        slices |= {"controls_AB": s.isin(*CONTROLS), "ageing_and_somatoform": s.isin(*strata.SPECIFICITY_STRATA)}
    tags = F.array_compact(F.array(*[F.when(case | negative, F.lit(name)) for name, negative in slices.items()]))
    sliced = rows.select(*keys, "grp", "value", case.alias("case"), F.explode(tags).alias("slice"))
    hit = F.col("value") >= metrics.DECISION_THRESHOLD
    wrong = rows.filter(~case).groupBy(*keys, "stratum").agg(metrics.share(~hit).alias("specificity"))
    positives = rows.filter(case).select(*keys, "value", F.lit(True).alias("case"))
    own = rows.filter(~case).select(*keys, "stratum", "value", F.lit(False).alias("case"))
    each = own.unionByName(positives.join(F.broadcast(own.select(*keys, "stratum").distinct()), keys))  # one row a model and stratum
    total = rows.groupBy(*keys).agg(metrics.share(F.when(case, hit)).alias("sensitivity"), metrics.share(F.when(~case, ~hit)).alias("_spec"), metrics.share(F.when(s.isin(*strata.SPECIFICITY_STRATA), ~hit)).alias("specificity_ageing_and_somatoform"))
    total = total.withColumn("balanced_accuracy", 0.5 * (F.col("sensitivity") + F.col("_spec"))).drop("_spec")
    out = {
        "n_by_stratum": next(iter(found.values())).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")),
        "auc": resample.auc_with_ci(sliced, [*keys, "slice"], "grp", "value", F.col("case"), n_boot),
        "by_stratum": ordered.auc(each, [*keys, "stratum"], "value", F.col("case")).join(wrong, [*keys, "stratum"], "left"),
        "threshold": total,
    }
    parts = [nested.candidate_frequency(oof).withColumn("model", F.lit(name)) for name, oof in found.items()]
    out["candidates"] = parts[0]
    for p in parts[1:]:
        out["candidates"] = out["candidates"].unionByName(p)
    for a, b in differences:
        if a in found and b in found:
            both = found[a].select("row", "grp", "y", F.col("p_raw").alias("_x")).join(found[b].select("row", F.col("p_raw").alias("_y")), "row")
            out[f"{a}_minus_{b}"] = resample.paired_auc_difference(both, [], "grp", "_x", "_y", F.col("y") == 1, n_boot)
    if two_aucs:
        areas = ordered.auc(rows, keys, "value", F.when(case, True).when(s.isin(*CONTROLS), False))
        out["score_estimate"] = areas.join(total, keys).select(
            *keys, metrics.points(F.col("auc"), 30.0).alias("auc_points_vs_controls_AB"), (20.0 * F.col("specificity_ageing_and_somatoform")).alias("specificity_points_ageing_and_somatoform")
        )
    return out


def missing_by_stratum(population: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of rows with any of the features missing, per stratum."""
    gap = F.lit(False)
    for n in names:
        gap = gap | F.coalesce(F.isnan(F.col(n).cast("double")), F.lit(False)) | F.col(n).isNull()
    return population.groupBy("stratum").agg(metrics.share(gap).alias("share_missing"))


def fit_final(population: DataFrame, limit: int = nested.BROADCAST_BYTES) -> tuple[learn.LogisticModel, DataFrame]:
    """The submitted two-branch model: C selected on all rows, fit on all rows, calibrated on inner out-of-fold rows."""
    from dataclasses import replace

    model, scores = nested.train_final(population, procedure("protocol5", TWO_BRANCHES[SUBMITTED], True), limit=limit)
    counts = {r["stratum"]: r["n"] for r in population.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}  # a fixed list of strata
    known = {"protocol": "protocol5", "feature_set": "trial1_behaviour+rest20", "preprocessing_variant": "native", "calibration": "platt on inner out-of-fold predictions", "n_subjects_trained": sum(counts.values()), "n_ptsd": counts.get(strata.PTSD, 0), "strata": counts}
    return replace(model, metadata={**model.metadata, **known}), scores


def unseen_controls(subjects: DataFrame, rest: DataFrame, task: DataFrame, population: DataFrame, model: learn.LogisticModel) -> tuple[DataFrame, DataFrame]:
    """Probabilities of all subjects without the case label outside the training population, and their shares per stratum."""
    rows = subjects.filter("label <> 1").join(rest.select("subject_key", *REST_EEG), "subject_key").join(task, "subject_key", "left").join(population.select("subject_key"), "subject_key", "left_anti")
    scored = checkpointed(rows.select("subject_key", "stratum", model.probability().alias("p"), model.probability_raw().alias("p_raw")))
    at = metrics.DECISION_THRESHOLD
    table = scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), metrics.share(F.col("p") >= at).alias("share_p_ge_05"), metrics.share(F.col("p_raw") >= at).alias("share_p_raw_ge_05"))
    return scored, table.join(ordered.median(scored, ["stratum"], "p", "median_p"), "stratum", "left")
