"""Command-line jobs: ``spark-submit -m sigloom.jobs`` or ``python -m sigloom.jobs <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import condition, cycles, evaluation, features, learn, nested, protocols, recordings, task_branch
from sigloom.session import checkpointed, get_session
from sigloom.sinks.single_file import write_csv
from sigloom.sources import registry as reg


BRANCH_PROTOCOLS = ("protocol4", "protocol5")


def feature_tables(spark: SparkSession, data: str, protocol: str) -> DataFrame:
    """Training rows of a registered protocol from a folder of recordings."""
    found, _, subjects = reg.scan(spark, data)
    chosen = protocols.PROTOCOLS[protocol]
    people = subjects.select("subject_key")
    table = features.subject_features(features.window_power(found), people)
    requantized = None
    if protocol == "protocol1":
        requantized = features.subject_features(features.window_power(found, recordings.VARIANTS["requantized"]), people)
    return checkpointed(protocols.training_table(subjects, table, chosen, requantized))


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, table in zip(("registry", "duplicate_links", "subjects"), reg.scan(spark, a.data)):
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")


def branch_tables(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects, resting and task features of a folder of recordings."""
    found, _, subjects = reg.scan(spark, data)
    power, people = features.window_power(found), subjects.select("subject_key")
    durations = features.usable_records(found).filter("usable AND condition = 'task'").select("subject_key", "trial", "active_duration_s")
    return subjects, checkpointed(features.subject_features(power, people)), checkpointed(features.task_features(power, durations, people))


def _write_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")


def evaluate_branches(spark: SparkSession, a: argparse.Namespace) -> None:
    """Protocol 4 (task branch) or 5 (two-branch model) over a folder of recordings."""
    subjects, rest, task = branch_tables(spark, a.data)
    if a.protocol == "protocol4":
        task.write.mode("overwrite").option("header", "true").csv(f"{a.out}/task_features")
        for name, population in task_branch.populations(subjects, task).items():
            models = task_branch.PLAN[name]
            found = task_branch.oofs(population, models)
            tables = task_branch.report(found, (("combined", "behaviour"), ("eeg", "behaviour")))
            names = sorted({f for m in models.values() for f in m})
            _write_report(tables | {"share_missing": task_branch.missing_by_stratum(population, names)}, f"{a.out}/metrics/{name}")
            for model, oof in found.items():
                oof.write.mode("overwrite").option("header", "true").csv(f"{a.out}/oof/{name}/{model}")
        return
    population = checkpointed(task_branch.two_branch_population(subjects, rest, task))
    found = task_branch.oofs(population, task_branch.TWO_BRANCHES, two_aucs=True)
    tables = task_branch.report(found, (("combined", "behaviour"), ("combined", "rest_eeg")), two_aucs=True)
    model, scores = task_branch.fit_final(population)
    unseen, shares = task_branch.unseen_controls(subjects, rest, task, population, model)
    _write_report(tables | {"selection_scores": scores, "unseen_controls": shares}, f"{a.out}/metrics")
    for name, oof in found.items():
        oof.write.mode("overwrite").option("header", "true").csv(f"{a.out}/oof/{name}")
    unseen.write.mode("overwrite").option("header", "true").csv(f"{a.out}/unseen_controls")
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/model")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.protocol in BRANCH_PROTOCOLS:
        evaluate_branches(spark, a)
        return
    rows, p = feature_tables(spark, a.data, a.protocol), protocols.PROTOCOLS[a.protocol].procedure
    oof = checkpointed(nested.nested_oof(rows, p))
    oof.join(rows.select("row", "subject_key", "export_family"), "row").write.mode("overwrite").option("header", "true").csv(f"{a.out}/nested_oof")
    aged = checkpointed(oof.join(rows.select("row", "age"), "row"))
    for score in ("p", "p_raw"):
        _write_report(evaluation.report(oof, score) | {"age_bands": evaluation.by_age_band(aged, score)}, f"{a.out}/metrics/{score}")
    # control: what the export settings alone can tell
    meta = checkpointed(evaluation.fixed_oof(rows, protocols.METADATA, scale=False))
    meta.write.mode("overwrite").option("header", "true").csv(f"{a.out}/metadata_oof")
    _write_report(evaluation.report(meta), f"{a.out}/metrics/metadata")
    if a.n_perm:
        controls = F.col("stratum").startswith("control_")
        observed = evaluation.report(oof)["auc"].filter("slice = 'controls_excl_ageing'").first()["value"]
        evaluation.permutation_test(rows, p, observed, a.n_perm, controls).write.mode("overwrite").json(f"{a.out}/permutation")


def history(spark: SparkSession, a: argparse.Namespace) -> None:
    """One sorted table of the areas of finished evaluations; ``--data`` is a folder of their output folders."""
    runs = {r: spark.read.json(f"{a.data}/{r}/metrics/p/auc") for r in a.runs.split(",")}
    write_csv(evaluation.history(runs), f"{a.out}/history.csv", ["run", "slice"])


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = feature_tables(spark, a.data, a.protocol)
    model, scores = nested.train_final(rows, protocols.PROTOCOLS[a.protocol].procedure)
    scores.write.mode("overwrite").json(f"{a.out}/selection_scores")
    # parameters only: a few numbers per feature
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/model")


def load_model(spark: SparkSession, path: str) -> learn.LogisticModel:
    return learn.LogisticModel.from_json(spark.read.text(path, wholetext=True).first()["value"])


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    features.run_scoring(spark, load_model(spark, a.model), a.data, a.out)


def robustness(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, p = feature_tables(spark, a.data, a.protocol), protocols.PROTOCOLS[a.protocol].procedure
    reference = checkpointed(nested.nested_oof(rows, p))
    for name in (strata.CONTROL_A, strata.CONTROL_C, strata.CONTROL_B_SUPPLEMENT, strata.AGEING, strata.SOMATOFORM):
        evaluation.unseen_batch(rows, p, reference, name).write.mode("overwrite").json(f"{a.out}/unseen_batch/{name}")
    if a.n_perm:
        inside = evaluation.within_format_b(F.col("stratum"))
        negatives = F.col("stratum").isin(*evaluation.FORMAT_B)
        label = F.when(F.col("stratum") == strata.PTSD, True).when(negatives, False)
        observed = evaluation.ordered.auc(reference, [], "p_raw", label).first()["auc"]
        evaluation.permutation_test(rows, p, observed, a.n_perm, negatives, "p_raw", inside).write.mode("overwrite").json(f"{a.out}/permutation_within_format_b")


def fold_cycles(spark: SparkSession, a: argparse.Namespace) -> None:
    found, _, _ = reg.scan(spark, a.data)
    usable = features.usable_records(found).filter("usable AND export_family IN ('A', 'B')").filter(F.col("condition") == a.condition)
    first = cycles_input(usable)
    band = cycles.CONFIRM_BAND_HZ if a.confirm else cycles.BAND_HZ
    halves = checkpointed(cycles.half_spectra(cycles.good_cycles(first.select("path", "file_bytes"))))
    records = cycles.record_spectra(halves).join(first.select("path", F.col("subject_key").alias("subject")), "path")
    cycles.report(records, a.n_surrogates, 42, band).write.mode("overwrite").json(f"{a.out}/{a.condition}")
    measures = checkpointed(cycles.record_measures(records, band))
    condition.group_curves(condition.aligned_curves(halves, measures, band)).write.mode("overwrite").parquet(f"{a.out}/curves_{a.condition}")
    condition.topography(halves, records, min(a.n_surrogates, condition.CHANNEL_SURROGATES), 42, band).write.mode("overwrite").json(f"{a.out}/channels_{a.condition}")
    measures.drop("curve").write.mode("overwrite").parquet(f"{a.out}/records_{a.condition}")


def cycles_input(usable: DataFrame) -> DataFrame:
    """One record per content, the one with the smallest relative path."""
    from sigloom.operators.fingerprint import keep_first

    return checkpointed(keep_first(usable.select("content_hash", "relpath", "path", "file_bytes", "subject_key"), "content_hash", "relpath"))


def main() -> None:
    parser = argparse.ArgumentParser(description="Recording analytics on Spark")
    sub = parser.add_subparsers(dest="job", required=True)
    for name, f in (("scan", scan), ("evaluate", evaluate), ("train", train), ("score", score), ("robustness", robustness), ("cycles", fold_cycles), ("history", history)):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
        if name in ("evaluate", "train", "robustness"):
            p.add_argument("--protocol", choices=sorted((*protocols.PROTOCOLS, *(BRANCH_PROTOCOLS if name == "evaluate" else ()))), default="protocol8")
            p.add_argument("--n-perm", type=int, default=0)
        if name == "history":
            p.add_argument("--runs", required=True, help="names of the runs, joined by commas")
        if name == "score":
            p.add_argument("--model", required=True)
        if name == "cycles":
            p.add_argument("--condition", choices=("rest", "task"), default="rest")
            p.add_argument("--n-surrogates", type=int, default=cycles.N_SURROGATES)
            p.add_argument("--confirm", action="store_true")
    a = parser.parse_args()
    a.run(get_session("sigloom"), a)


if __name__ == "__main__":
    main()
