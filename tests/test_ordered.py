"""Bucketed order statistics against pandas, with a key that holds a third of the rows and many ties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.operators import folds, metrics, ordered, runs


@pytest.fixture(params=["small", "bucketed"], autouse=True)
def both_paths(request, monkeypatch):
    """Run everything once on the plain path and once with every table cut into buckets."""
    if request.param == "bucketed":
        monkeypatch.setattr(ordered.range_bucket, "__defaults__", (*ordered.range_bucket.__defaults__[:-1], -1))
        monkeypatch.setattr(ordered.settle, "__defaults__", ((), -1))
    return request.param


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n)), "v": rng.integers(0, 60, n).astype(float), "y": rng.random(n) < 0.3})
    pdf["flag"] = rng.random(n) < 0.2
    return pdf, spark.createDataFrame(pdf)


def pair_auc(v, y):
    a, b = v[y], v[~y]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (a.size * b.size)


def test_auc_matches_pairs(table):
    pdf, df = table
    got = {r["k"]: r["auc"] for r in ordered.auc(df, ["k"], "v", F.col("y")).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(pair_auc(g["v"].to_numpy(), g["y"].to_numpy()))


def test_weighted_auc_equals_repeated_rows(table):
    pdf, df = table
    w = (pdf["id"] % 3).to_numpy()
    rep = pdf.loc[pdf.index.repeat(w)]
    got = ordered.auc(df, [], "v", F.col("y"), F.col("id") % 3).first()["auc"]
    assert got == pytest.approx(pair_auc(rep["v"].to_numpy(), rep["y"].to_numpy()))


@pytest.mark.parametrize("levels", [1, 4, 9])
def test_scan_does_not_depend_on_buckets(table, levels, both_paths):
    pdf, df = table
    rows = ordered.range_bucket(df, "v", levels=levels)
    assert (ordered.BUCKET in ordered.range_bucket(df, "v").columns) == (both_paths == "bucketed")
    out = ordered.scan(rows, ["k"], ["v", "id"], {"cum": F.col("id")}, {"all": "cum"}, {"before": "id"}, {"after": "id"}, "pos").toPandas()
    want = pdf.sort_values(["k", "v", "id"])
    g = want.groupby("k")["id"]
    want = want.assign(cum=g.cumsum(), all=g.transform("sum"), before=g.shift(1), after=g.shift(-1), pos=g.cumcount() + 1)
    cols = ["cum", "all", "before", "after", "pos"]
    pd.testing.assert_frame_equal(out.sort_values("id", ignore_index=True)[cols].astype(float), want.sort_values("id", ignore_index=True)[cols].astype(float))


def test_quantiles_match_linear_interpolation(table):
    pdf, df = table
    got = ordered.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "b", "c"]].astype(float), np.quantile(g["v"], [0.1, 0.5, 0.95]))


def test_runs_and_dilation(table):
    pdf, df = table
    found = runs.true_runs(df, ["k"], ["id"], "flag").toPandas().sort_values(["k", "run"])
    for k, g in pdf.groupby("k"):
        block = (g["flag"] != g["flag"].shift()).cumsum()
        assert list(found[found["k"] == k]["n"]) == list(g.groupby(block).size())
    wide = runs.dilate(df, ["k"], ["id"], F.col("flag"), 2, "near").toPandas().set_index("id")["near"]
    for _, g in pdf.groupby("k"):
        f = g["flag"].to_numpy()
        want = np.convolve(f, np.ones(5), "full")[2:-2] > 0
        assert list(wide.loc[g["id"]]) == list(want)


def test_spearman_matches_pandas(table):
    pdf, df = table
    got = metrics.spearman(df.withColumn("u", F.col("id") % 37), [], "v", "u").first()["rho"]
    assert got == pytest.approx(pdf["v"].rank().corr((pdf["id"] % 37).rank()))


def test_equal_error_balances_sensitivity_and_specificity(spark):
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(1.5, 1, 40), rng.normal(0.5, 1, 40)])
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": np.arange(80) < 40}))
    shift = metrics.equal_error_shift(df, "z", F.col("y"), ~F.col("y")).first()["shift"]
    assert abs((z[:40] >= shift).mean() - (z[40:] < shift).mean()) < 0.03


def test_group_folds_keep_groups_together_and_balanced(table):
    pdf, df = table
    rows = df.withColumn("g", F.floor(F.col("id") / 3))
    got = folds.stratified_group_folds(rows, "g", "y", 5).toPandas()
    assert got["g"].is_unique and len(got) == 200
    share = pdf.assign(g=pdf["id"] // 3).merge(got, on="g").groupby("fold")["y"].agg(["mean", "size"])
    assert share["size"].max() - share["size"].min() <= 9
    assert share["mean"].max() - share["mean"].min() < 0.1


def test_shuffled_index_is_a_permutation(table):
    _, df = table
    out = folds.shuffled_index(df, "id", 7).toPandas()
    assert sorted(out["idx"]) == list(range(600)) and list(out.sort_values("id")["idx"]) != list(range(600))
