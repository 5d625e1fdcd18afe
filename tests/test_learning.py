"""Fits, calibration, nested selection and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sigloom.operators import folds, learn, nested, ordered, replicates, resample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 120
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 3)) + np.outer(y, [1.2, 0.0, -0.5])
    pdf = pd.DataFrame({"row": np.arange(n), "grp": np.arange(n) // 20, "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    pdf["stratum"] = np.where(y == 1, "ptsd", rng.choice(["control_A", "control_B", "somatoform", "control_ageing"], n))
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_distributed_newton_matches_spark_ml(rows):
    pdf, df = rows
    c, names = 0.3, ["a", "b", "c"]
    m = learn.fit_logistic(df, names, "y", c)
    z = df.select("y", *[v.alias(n) for n, v in zip(names, m.standardized())])
    n, pos = len(pdf), pdf["y"].sum()
    z = z.withColumn("w", F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    z = VectorAssembler(inputCols=names, outputCol="f").transform(z)
    ref = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=1 / (c * n), standardization=False, maxIter=500, tol=1e-12).fit(z)
    np.testing.assert_allclose(m.coef, ref.coefficients.toArray(), atol=1e-5)
    assert m.intercept == pytest.approx(ref.intercept, abs=1e-5)
    assert m.impute_values[1] == pytest.approx(pdf["b"].median())


def test_local_solver_equals_distributed(rows):
    pdf, df = rows
    m = learn.fit_logistic(df, ["a", "c"], "y", 0.1)
    x = ((pdf[["a", "c"]] - pdf[["a", "c"]].mean()) / pdf[["a", "c"]].std(ddof=0)).to_numpy()
    n, pos = len(pdf), pdf["y"].sum()
    beta = learn.solve_local(x, pdf["y"].to_numpy(float), np.where(pdf["y"] == 1, n / (2 * pos), n / (2 * (n - pos))), 0.1)
    np.testing.assert_allclose([*m.coef, m.intercept], beta, atol=1e-7)


def test_json_round_trip_and_safe_scores(rows):
    _, df = rows
    m = learn.LogisticModel(("a", "b"), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0), (1.0, -1.0), 0.2, {"C": 0.1}, (0.9, 0.1))
    again = learn.LogisticModel.from_json(m.to_json())
    assert again == m
    p, raw, parts = df.select(again.safe_probability().alias("p"), again.log_odds().alias("r"), sum(again.contributions(), F.lit(0.2)).alias("s")).toPandas().T.to_numpy()
    assert np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()
    np.testing.assert_allclose(raw, parts)


PROTOCOL = nested.Protocol("tiny", {"all": ("a", "b", "c"), "one": ("a",)}, (nested.Candidate(0.1, "control", "all", 3.0),), equal_error=True)


def test_nested_broadcast_and_distributed_paths_agree(rows):
    pdf, df = rows
    few = df.filter("grp < 3")
    one = nested.nested_oof(few, PROTOCOL).toPandas().set_index("row").sort_index()
    two = nested.nested_oof(few, PROTOCOL, limit=0).toPandas().set_index("row").sort_index()
    assert len(one) == 60 and one.index.is_unique
    for c in ("p_raw", "p", "cal_a", "cal_b"):
        np.testing.assert_allclose(one[c].astype(float), two[c].astype(float), atol=1e-5)


def test_masking_the_informative_feature_hurts(rows):
    _, df = rows
    p = nested.Protocol("p", {"one": ("a",)}, (nested.Candidate(0.3, "control+somatoform", "one"),), calibrate=False)
    full = ordered.auc(nested.nested_oof(df, p), [], "p_raw", F.col("y") == 1).first()["auc"]
    masked = ordered.auc(nested.nested_oof(df, p, mask_at_test=["a"]), [], "p_raw", F.col("y") == 1).first()["auc"]
    assert full > 0.7 and masked < 0.6


def test_group_bootstrap_brackets_the_value_and_same_scores_differ_by_zero(rows):
    _, df = rows
    df = df.withColumn("g", F.col("row") % 30)
    ci = resample.auc_with_ci(df, [], "g", "a", F.col("y") == 1, 200).first()
    assert ci["ci_low"] < ci["value"] < ci["ci_high"] and ci["ci_high"] - ci["ci_low"] < 0.4
    d = resample.paired_auc_difference(df.withColumn("a2", F.col("a")), [], "g", "a", "a2", F.col("y") == 1, 20).first()
    assert d["value"] == d["ci_low"] == d["ci_high"] == 0.0


def test_draws_use_every_slot():
    reps = np.arange(300)
    m = replicates.multiplicities(12345, 40, reps, np.arange(40))
    assert (m.sum(axis=0) == 40).all() and abs((m == 0).mean() - (1 - 1 / 40) ** 40) < 0.01
    assert len({tuple(c) for c in m.T}) == 300 and np.abs(np.corrcoef(m.T) - np.eye(300)).max() < 0.75
    some = replicates.multiplicities(12345, 40, reps[7:20], np.array([3, 30]))
    assert (some == m[[3, 30], 7:20]).all()


@pytest.mark.parametrize("small", [10**6, 0])
def test_replicate_vectors_equal_drawn_rows(rows, monkeypatch, small):
    pdf, df = rows
    monkeypatch.setattr(ordered, "SMALL_ROWS", small)
    df, pdf = df.withColumns({"g": F.col("row") % 17, "s": F.round("a", 1), "k": F.col("grp") % 2}), pdf.assign(g=pdf["row"] % 17, s=pdf["a"].round(1), k=pdf["grp"] % 2)
    got = resample.bootstrap_auc(df, ["k"], "g", ["s"], F.col("y") == 1, 25).toPandas().set_index(["k", "rep"])["s"]
    bases = {(r["k"], r["_cls"]): r["_base"] for r in replicates.indexed(df.withColumn("_cls", F.when(F.col("y") == 1, "pos").otherwise("neg")), ["k", "_cls"], "g", 42).collect()}
    for k in (0, 1):
        draws = {}
        for cls, y in (("pos", 1), ("neg", 0)):
            part = pdf[(pdf["k"] == k) & (pdf["y"] == y)]
            groups = sorted(part["g"].unique())
            m = replicates.multiplicities(bases[k, cls], len(groups), np.arange(25), np.arange(len(groups)))
            draws[cls] = [np.repeat(part["s"].to_numpy(), m[[groups.index(g) for g in part["g"]], b].astype(int)) for b in range(25)]
        for b in range(25):
            p, q = draws["pos"][b][:, None], draws["neg"][b][None, :]
            assert got[k, b] == pytest.approx(((p > q) + 0.5 * (p == q)).mean())


def test_permutation_keeps_pairs_and_respects_the_mask(rows):
    pdf, df = rows
    moved = resample.permuted_labels(df.withColumn("g", F.col("row")), "g", "row", ["y", "stratum"], 3).toPandas()
    for _, m in moved.groupby("perm"):
        assert sorted(map(tuple, m[["y", "stratum"]].to_numpy())) == sorted(map(tuple, pdf[["y", "stratum"]].to_numpy()))
    inside = resample.permuted_labels(df.withColumn("g", F.col("row")), "g", "row", ["stratum"], 2, inside=F.col("stratum").isin("ptsd", "control_B")).toPandas()
    assert set(inside["stratum"]) == {"ptsd", "control_B"}


def test_verdicts(spark):
    cases = [((0.8, 0.7, 0.9, 0.75, 0.4, 0.6), "shared with somatoform"), ((0.8, 0.7, 0.9, 0.5, 0.6, 0.8), "specific to PTSD"), ((0.55, 0.45, 0.65, 0.5, 0.4, 0.6), "no difference")]
    for values, want in cases:
        got = spark.range(1).select(resample.specificity_verdict(*[F.lit(v) for v in values]).alias("v")).first()["v"]
        assert got == want


def test_fixed_ridge_and_repeated_folds(rows):
    from sigloom.operators import evaluation

    pdf, df = rows
    oof = evaluation.fixed_oof(df, ["a", "c"]).toPandas()
    assert len(oof) == 120 and ordered.auc(df.sparkSession.createDataFrame(oof), [], "p", F.col("y") == 1).first()["auc"] > 0.7
    raw = evaluation.fixed_oof(df, ["a"], scale=False).toPandas()
    assert raw["p"].between(0, 1).all()

    aged = df.withColumn("age", 40 + 8 * F.col("a") - 3 * F.col("c"))
    r = evaluation.ridge_oof(aged, ["a", "c"], "age").toPandas()
    assert 1 - ((r["target"] - r["predicted"]) ** 2).sum() / ((r["target"] - r["reference"]) ** 2).sum() > 0.98
    lost = evaluation.ridge_oof(aged.withColumn("u", F.rand(1)), ["u"], "age").toPandas()
    assert 1 - ((lost["target"] - lost["predicted"]) ** 2).sum() / ((lost["target"] - lost["reference"]) ** 2).sum() < 0.1

    p = nested.Protocol("p", {"one": ("a",)}, (nested.Candidate(0.3, "control+somatoform", "one"),), calibrate=False)
    t = evaluation.fold_aucs(df, p, {"controls": ("control_A", "control_B"), "none": ("absent",)}, n_splits=3, n_repeats=2).toPandas()
    assert len(t) == 6 and t["none"].isna().all() and t["controls"].dropna().between(0, 1).all()


def test_report_unseen_batch_and_permutation(rows):
    from sigloom.operators import evaluation

    _, df = rows
    p = nested.Protocol("p", {"two": ("a", "c")}, (nested.Candidate(0.3, "control+somatoform", "two"),), equal_error=False)
    oof = nested.nested_oof(df, p)
    tables = evaluation.report(oof, n_boot=20)
    auc = tables["auc"].toPandas().set_index("slice")
    assert (auc["ci_low"] <= auc["value"]).all() and auc.loc["all_non_ptsd", "value"] > 0.6
    assert tables["reliability"].agg(F.sum("n")).first()[0] == 120 and tables["calibration"].first()["a_median"] > 0
    u = evaluation.unseen_batch(df, p, oof, "control_A", n_boot=20).first()
    assert 0.4 < u["auc_unseen"] <= 1 and u["n"] == df.filter("stratum = 'control_A'").count()
    t = evaluation.permutation_test(df, p, 0.99, 2, F.col("stratum").startswith("control_")).first()
    assert t["n_permutations"] == 2 and t["p_value"] == pytest.approx(1 / 3)


def test_small_and_large_paths_agree(spark):
    from sigloom.operators import evaluation

    rng = np.random.default_rng(5)
    rows = [(i, i % 6, float(rng.normal(3 * (i % 2), 2)), float(rng.normal()), "ptsd" if i % 2 else "control_A", i % 2, float(40 + i)) for i in range(36)]
    df = spark.createDataFrame(rows, "row long, grp long, a double, c double, stratum string, y int, age double")
    for scale in (True, False):
        few, many = (evaluation.fixed_oof(df, ["a", "c"], scale=scale, limit=limit).toPandas().set_index("row")["p"].sort_index() for limit in (1 << 20, 0))
        assert np.allclose(few, many, atol=1e-7)
    one, blocks = (evaluation.ridge_oof(df, ["a", "c"], "age", limit=limit).toPandas().set_index("row").sort_index() for limit in (1 << 20, 200))
    assert np.allclose(one, blocks)


def test_a_fit_that_does_not_settle_is_an_error(monkeypatch):
    from sigloom.operators import learn

    monkeypatch.setattr(learn, "MAX_STEPS", 1)
    x = np.random.default_rng(0).normal(size=(20, 2))
    with pytest.raises(RuntimeError, match="converge"):
        learn.solve_local(x, (x[:, 0] > 0).astype(float), np.ones(20), 1.0)


def test_string_keys_with_a_common_beginning_spread(spark):
    df = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(400)], "k string")
    from sigloom.operators import ordered

    before, ordered.SMALL_ROWS = ordered.SMALL_ROWS, 0
    try:
        b = folds._order_bucket(df, "k", "b").groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
        index = {r["k"]: r["idx"] for r in folds.dense_index(df, "k").collect()}
    finally:
        ordered.SMALL_ROWS = before
    assert len(b) >= 8 and max(r["n"] for r in b) <= 100 and all(x["hi"] < y["lo"] for x, y in zip(b, b[1:]))
    assert [index[f"Customer#{i:09d}"] for i in range(400)] == list(range(400))


@pytest.mark.parametrize("masked", [False, True])
def test_permutations_in_one_job_equal_the_serial_form(rows, masked):
    from sigloom.operators import permutations

    _, df = rows
    p = nested.Protocol("p", {"two": ("a", "c"), "one": ("b",)}, tuple(nested.Candidate(c, n, f, w) for f, w in (("two", 3.0), ("one", 1.0)) for n in nested.NEGATIVES for c in (0.03, 0.3)), ("control_A", "control_B"))
    inside = F.col("stratum").isin("ptsd", "control_A", "control_B") if masked else None
    negatives = F.col("stratum").startswith("control_")
    moved = permutations.permuted_strata(df, 3, 42, inside).toPandas()
    oof = permutations.permuted_oof(df, p, 3, inside=inside)
    one = oof.toPandas().set_index(["perm", "row"]).sort_index()
    areas = {r["permutation"]: r["auc"] for r in permutations.null_distribution(df, p, 3, negatives, inside=inside).collect()}
    keep = F.lit(True) if inside is None else inside
    for perm in range(3):
        labels = df.sparkSession.createDataFrame([(int(g), None if pd.isna(y) else int(y), s) for g, y, s in moved[moved["perm"] == perm][["grp", "_y", "_stratum"]].to_numpy().tolist()], "grp long, _y int, _stratum string")
        swap = keep & F.col("_stratum").isNotNull()
        again = df.join(labels, "grp", "left").withColumn("_s", swap).withColumns({"y": F.when(F.col("_s"), F.col("_y")).otherwise(F.col("y")), "stratum": F.when(F.col("_s"), F.col("_stratum")).otherwise(F.col("stratum"))})
        serial = nested.nested_oof(again.drop("_y", "_stratum", "_s"), p).toPandas().set_index("row").sort_index()
        mine = one.loc[perm]
        assert list(serial["stratum"]) == list(mine["stratum"]) and list(serial["y"]) == list(mine["y"])
        np.testing.assert_allclose(serial["p_raw"], mine["p_raw"], atol=1e-6)
        np.testing.assert_allclose(serial["p"], mine["p"], atol=1e-5)
        pos, neg = (mine["stratum"] == "ptsd").to_numpy(), mine["stratum"].str.startswith("control_").to_numpy()
        assert areas[perm] == pytest.approx(permutations.area(pos, neg, mine["p"].to_numpy()))


def test_ordered_choice_needs_a_real_gain(spark):
    scores = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5 + 1e-13), (0, 2, 0.7), (0, 3, 0.7 + 1e-11), (1, 1, 0.2), (1, 0, 0.3)], "outer long, candidate int, score double")
    p = nested.Protocol("p", {"f": ("a",)}, tuple(nested.Candidate(c, "control", "f") for c in (0.1, 0.2, 0.3, 0.4)), ordered_choice=True)
    assert sorted(map(tuple, nested.choose(scores, p).select("outer", "candidate").collect())) == [(0, 3), (1, 0)]


def test_batched_standardisation_is_exact_and_needs_no_more_jobs_for_more_folds(spark):
    from sigloom.operators import batched

    rng = np.random.default_rng(4)
    n = 400
    x = np.stack([rng.normal(size=n), np.round(rng.normal(size=n)), np.where(rng.random(n) < 0.4, np.nan, -rng.random(n) * 1e9), np.full(n, 3.25), np.full(n, np.nan)], axis=1)
    pdf = pd.DataFrame({"row": np.arange(n), "outer": np.arange(n) % 7, "fold": np.arange(n) % 7 % 5, "y": (rng.random(n) < 0.4).astype(int), "stratum": rng.choice(["ptsd", "somatoform", "control_A"], n)})
    for j in range(5):
        pdf[f"f{j}"] = x[:, j]
    rows = spark.createDataFrame(pdf).repartition(3)
    names, jobs = [f"f{j}" for j in range(5)], []
    for outers in (2, 7):
        fits = [batched.Fit(o, f, c, (0,), 1.0, 0.1, 0) for o in range(outers) for f in (0, batched.NONE) for c in (False, True)]
        spark.sparkContext.setJobGroup(f"batched-{outers}", "count")
        std = batched.standardised(rows, names, fits)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batched-{outers}")))
        for b, (o, f, c) in enumerate(std.bases):
            own = pdf[(pdf["outer"] != o) & (pdf["fold"] != f) & ~((pdf["stratum"] == "somatoform") & c)]
            med = own[names].median().fillna(0).to_numpy()
            full = np.where(np.isnan(own[names]), med, own[names])
            np.testing.assert_array_equal(std.fill[b], med)
            np.testing.assert_allclose(std.mean[b], full.mean(axis=0), rtol=1e-9, atol=1e-12)
            np.testing.assert_allclose(std.scale[b], np.where(full.std(axis=0) > 0, full.std(axis=0), 1), rtol=1e-9)
            spec = own["stratum"] == "somatoform"
            assert list(std.mass[b]) == [len(own), own["y"].sum(), spec.sum(), own["y"][spec].sum()]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    keys = np.array([-np.inf, -3.0, -0.0, 0.0, 1e-300, 2.5, np.inf])
    np.testing.assert_array_equal(batched.from_keys(batched.ordered_keys(keys)), keys)
    assert (np.diff(batched.ordered_keys(keys).astype(float)) >= 0).all()


def test_fold_tasks_send_bounded_lists_and_lose_nothing():
    sent = [(3, k, np.arange(n), np.full(n, k / 10)) for k, n in enumerate((0, 25, 7, 3, 40))]
    lists = list(nested._bounded(iter(sent), 10))
    assert [sum(len(t) for *_, t, _ in part) for part in lists] == [10] * 7 + [5]
    rows = [(o, c, int(r), float(v)) for part in lists for o, c, t, p in part for r, v in zip(t, p, strict=True)]
    assert rows == [(o, c, int(r), float(v)) for o, c, t, p in sent for r, v in zip(t, p, strict=True)]


def test_calibrations_hold_points_as_columns(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 600)
    oof = pd.DataFrame({"outer": np.arange(600) % 3, "stratum": "x", "y": (rng.uniform(size=600) < p).astype(float), "p": p})
    protocol = nested.Protocol("t", {"a": ("a",)}, (nested.Candidate(1.0, "control", "a"),), equal_error=False)
    out = nested.calibrations(spark.createDataFrame(oof), ["outer"], protocol)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        own = oof[oof.outer == r["outer"]]
        n, cases = len(own), own.y.sum()
        w = np.where(own.y == 1, n / (2 * cases), n / (2 * (n - cases)))
        want = nested.learn.solve_local(np.log(own.p / (1 - own.p)).to_numpy()[:, None], own.y.to_numpy(), w, nested.learn.PLATT_C)
        assert np.allclose([r["a"], r["b"]], want, atol=1e-7)


def test_newton_terms_are_loss_and_sums():
    rng = np.random.default_rng(4)
    n = learn.CACHED_ROWS + 70
    x = np.column_stack([rng.normal(size=(n, 2)) * 30, np.ones(n)])
    y, w, beta = (rng.random(n) < 0.5).astype(float), rng.uniform(0.5, 2.0, n), np.array([1.5, -2.0, 0.3])
    loss, grad, hess = learn.newton_terms(x, y, w, beta)
    assert loss == pytest.approx(learn.logistic_loss(x, y, w, beta), rel=1e-12)
    for got, want in zip((grad, hess), learn.newton_sums(x, y, w, beta), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_permutations_of_a_table_that_no_task_holds(rows):
    from sigloom.operators import permutations

    _, df = rows
    p = nested.Protocol("p", {"one": ("a",)}, (nested.Candidate(0.3, "control+somatoform", "one"),), ("control_A", "control_B"), calibrate=False)
    one, two = (permutations.permuted_oof(df, p, 1, limit=n).toPandas().set_index(["perm", "row"]).sort_index() for n in (nested.BROADCAST_BYTES, 0))
    assert list(one["stratum"]) == list(two["stratum"]) and list(one["y"]) == list(two["y"]) and list(one["candidate"]) == list(two["candidate"])
    np.testing.assert_allclose(one["p_raw"], two["p_raw"], atol=1e-6)
