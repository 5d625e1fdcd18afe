"""Task branch and two-branch model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import nested, permutations, task_branch

NAMES = (*task_branch.TRIAL1_BEHAVIOUR, *task_branch.DYNAMICS_BEHAVIOUR, *task_branch.TRIAL1_EEG, *task_branch.DYNAMICS_EEG)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    strata = ["ptsd", "control_A", "control_B", "control_ageing", "somatoform", "control_C"]
    people, task, rest = [], [], []
    for i in range(84):
        s = strata[i % 6]
        key, y = f"g/s{i:02d}", int(s == "ptsd")
        people.append((key, y, s, s[-1] if s in ("control_A", "control_B", "control_C") else "A", s == "control_ageing", i % 29 != 0, i // 12))
        values = {n: float(rng.normal(1.5 * y if n.startswith("beh") else 0.8 * y)) for n in NAMES}
        if i % 17 == 5 or s == "control_C":
            values |= dict.fromkeys(n for n in NAMES if n.startswith("beh")) | {task_branch.TRIAL1_EEG[0]: None}
        task.append((key, *[values[n] for n in NAMES]))
        rest.append((key, *[float(rng.normal(0.9 * y)) for _ in task_branch.REST_EEG]))
    subjects = spark.createDataFrame(people, "subject_key string, label int, stratum string, export_family string, holdout boolean, has_task_files boolean, split_group long")
    doubles = lambda names: ", ".join(f"{n} double" for n in names)
    return subjects, spark.createDataFrame(rest, f"subject_key string, {doubles(task_branch.REST_EEG)}"), spark.createDataFrame(task, f"subject_key string, {doubles(NAMES)}"), people


def test_populations(tables):
    subjects, rest, task, people = tables
    got = {n: {r["subject_key"] for r in p.collect()} for n, p in task_branch.populations(subjects, task).items()}
    solved = {p[0] for i, p in enumerate(people) if p[5] and i % 17 != 5 and p[2] != "control_C"}
    assert got["trial1"] == solved and got["dynamics"] == {k for k in solved if not next(p for p in people if p[0] == k)[4]}
    assert got["trial1_eeg_with_format_C"] == solved | {p[0] for p in people if p[5] and p[3] == "C"}


def test_nested_selection_of_c_against_the_local_procedure(tables):
    subjects, rest, task, _ = tables
    population = task_branch.two_branch_population(subjects, rest, task)
    for two in (False, True):
        found = task_branch.oofs(population, {"combined": task_branch.TWO_BRANCHES["combined"]}, two)["combined"].toPandas().set_index("row")
        p = task_branch.procedure("combined", task_branch.TWO_BRANCHES["combined"], two)
        inner = nested.folds.stratified_group_folds(population, "grp", "stratum", nested.INNER_SPLITS, 42)
        m = nested._matrix(population.join(inner, "grp").withColumn("outer", F.col("grp").cast("long")), p)
        for outer in np.unique(m.outer):
            test, raw, cal, best = permutations.procedure(m, outer, p)
            own = found.loc[m.row[test]]
            np.testing.assert_allclose(own["p_raw"], raw, atol=1e-6)
            np.testing.assert_allclose(own["p"], cal, atol=1e-5)
            assert set(own["candidate"]) == {nested.candidate_text(p.candidates[best])}


def test_reports_and_final_model(tables):
    subjects, rest, task, _ = tables
    population = task_branch.two_branch_population(subjects, rest, task)
    found = task_branch.oofs(population, {n: task_branch.TWO_BRANCHES[n] for n in ("behaviour", "combined")}, True)
    out = {n: t.toPandas() for n, t in task_branch.report(found, (("combined", "behaviour"), ("combined", "rest_eeg")), True, n_boot=50).items()}
    auc = out["auc"].set_index(["model", "score", "slice"])
    assert len(auc) == 12 and (auc["ci_low"] <= auc["value"]).all() and auc.loc[("combined", "p_raw", "all_non_ptsd"), "value"] > 0.8
    assert len(out["combined_minus_behaviour"]) == 1 and "combined_minus_rest_eeg" not in out
    assert set(out["by_stratum"]["stratum"]) == {"control_A", "control_B", "control_ageing", "somatoform"} and len(out["by_stratum"]) == 16
    assert out["score_estimate"]["auc_points_vs_controls_AB"].between(0, 30).all() and out["candidates"]["n"].sum() == 2 * population.select("grp").distinct().count()
    model, scores = task_branch.fit_final(population)
    assert model.feature_names == task_branch.TWO_BRANCHES["combined"] and model.calibration and scores.count() == 5 and model.metadata["n_ptsd"] == population.filter("y = 1").count()
    unseen, shares = task_branch.unseen_controls(subjects, rest, task, population, model)
    assert unseen.count() == subjects.filter("label <> 1").count() - population.filter("y <> 1").count()
    assert shares.agg(F.sum("n")).first()[0] == unseen.count() and unseen.filter("p IS NULL OR p < 0 OR p > 1").count() == 0
    gaps = {r["stratum"]: r["share_missing"] for r in task_branch.missing_by_stratum(task_branch.populations(subjects, task)["trial1_eeg_with_format_C"], task_branch.TRIAL1_EEG).collect()}
    assert gaps["control_C"] == 1.0 and gaps["ptsd"] == 0.0
