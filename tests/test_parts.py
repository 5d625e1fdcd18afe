"""Fits of overlapping training sets by parts against the fit of each training set by itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.operators import nested, ordered, parts, permutations

CANDIDATES = tuple(nested.Candidate(c, n, f, w) for f, w in (("three", 1.0), ("two", 3.0)) for n in nested.NEGATIVES for c in (0.03, 0.3, 1.0))
PROTOCOL = nested.Protocol("p", {"three": ("a", "b", "c"), "two": ("c", "a")}, CANDIDATES, ("control_A", "control_B"), equal_error=True)


def made_up(n: int, groups: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.6).astype(int)
    x = rng.normal(size=(n, 3)) + np.outer(y, [0.6, 0.0, -0.3])
    pdf = pd.DataFrame({"row": np.arange(n), "grp": rng.integers(0, groups, n), "y": y, "a": x[:, 0], "b": np.round(x[:, 1], 1), "c": x[:, 2]})
    pdf["stratum"] = np.where(y == 1, "ptsd", rng.choice(["control_A", "control_B", "somatoform", "control_ageing"], n))
    pdf.loc[rng.random(n) < 0.15, "b"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made_up(1500)).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))


def matrix(rows) -> nested._Matrix:
    inner = nested.folds.stratified_group_folds(rows, "grp", "stratum", nested.INNER_SPLITS, 42)
    return nested._matrix(rows.join(inner, "grp").withColumn("outer", F.col("grp").cast("long")), PROTOCOL)


def test_medians_and_scales_of_parts_are_those_of_their_rows(rows):
    m = matrix(rows)
    own = m.parts(PROTOCOL.features)
    for o in m.outers:
        mask = (m.part_outer != o) & (m.part_stratum != "somatoform")
        x = m.x[np.repeat(mask, np.diff(m.start))]
        med = np.nanmedian(x, axis=0)
        full = np.where(np.isnan(x), med, x)
        fill, mean, sd = own.standard(mask)
        np.testing.assert_allclose(fill * own.spread + own.centre, med, atol=1e-12)
        np.testing.assert_allclose(mean * own.spread + own.centre, full.mean(axis=0), atol=1e-12)
        np.testing.assert_allclose(sd * own.spread, full.std(axis=0), atol=1e-12)


def test_areas_count_ties_as_one_half():
    rng = np.random.default_rng(2)
    for n, m in ((5, 40), (40, 5), (9, 9), (0, 3)):
        p, q = np.sort(rng.integers(0, 6, n).astype(float)), np.sort(rng.integers(0, 6, m).astype(float))
        want = ((p[:, None] > q) + 0.5 * (p[:, None] == q)).mean() if n else None
        assert parts.area_of(p, q) == (None if want is None else pytest.approx(want))


def test_outer_folds_share_passes_and_equal_fits_of_their_own(spark, monkeypatch):
    m = matrix(spark.createDataFrame(made_up(20_000)))
    passes, newton = [0], parts.Parts.newton

    def counted(*args):
        passes[0] += 1
        return newton(*args)

    monkeypatch.setattr(parts.Parts, "newton", counted)
    found = list(permutations.procedures(m, m.outers, PROTOCOL))
    assert [o for o, *_ in found] == m.outers
    assert passes[0] < len(m.outers) * nested.INNER_SPLITS * len(CANDIDATES) * 0.8  # a fit alone takes several
    for outer, which, raw, p, best in found:
        test, raw_alone, p_alone, best_alone = permutations.procedure(m, outer, PROTOCOL)
        assert best == best_alone and (np.flatnonzero(np.repeat(which, np.diff(m.start))) == test).all()
        np.testing.assert_allclose(raw, raw_alone, atol=1e-9)
        np.testing.assert_allclose(p, p_alone, atol=1e-8)


@pytest.mark.parametrize(("hidden", "calibrate"), [((), True), (("a",), False)])
def test_nested_selection_sends_models_instead_of_rows(rows, monkeypatch, hidden, calibrate):
    protocol = nested.replace(PROTOCOL, calibrate=calibrate)
    one = nested.nested_oof(rows, protocol, mask_at_test=hidden).toPandas().set_index("row").sort_index()
    monkeypatch.setattr(parts, "PART_ROWS", 1)
    monkeypatch.setattr(nested, "inner_oof", None)  # no table of out-of-fold rows of every candidate
    two = nested.nested_oof(rows, protocol, mask_at_test=hidden).toPandas().set_index("row").sort_index()
    assert list(one.columns) == list(two.columns) and list(one["candidate"]) == list(two["candidate"]) and (one["grp"] == two["grp"]).all()
    for c in ("p_raw", "p", "score", *(("cal_a", "cal_b") if calibrate else ())):
        np.testing.assert_allclose(one[c].astype(float), two[c].astype(float), atol=1e-6)
    assert calibrate or two["cal_a"].isna().all()


@pytest.mark.parametrize("masked", [False, True])
def test_permutations_of_long_parts_send_areas(rows, monkeypatch, masked):
    inside = F.col("stratum").isin("ptsd", "control_A", "control_B") if masked else None
    negatives = F.col("stratum").startswith("control_")
    n = 2 * rows.sparkSession.sparkContext.defaultParallelism
    few = nested.replace(PROTOCOL, candidates=CANDIDATES[:2])
    plain = permutations.permuted_oof(rows, few, 2, inside=inside).toPandas().set_index(["perm", "row"]).sort_index()
    monkeypatch.setattr(parts, "PART_ROWS", 1)
    by_parts = permutations.permuted_oof(rows, few, 2, inside=inside).toPandas().set_index(["perm", "row"]).sort_index()
    assert (plain[["stratum", "y", "candidate"]] == by_parts[["stratum", "y", "candidate"]]).all().all()
    np.testing.assert_allclose(plain[["p_raw", "p"]], by_parts[["p_raw", "p"]], atol=1e-6)
    monkeypatch.setattr(ordered, "auc", None)  # no ordered pass over the rows of all permutations
    areas = permutations.null_distribution(rows, few, n, negatives, "p_raw", inside=inside).toPandas().set_index("permutation")["auc"]
    assert sorted(areas.index) == list(range(n))
    for perm in (0, 1):
        own = plain.loc[perm]
        pos, neg = (own["stratum"] == "ptsd").to_numpy(), own["stratum"].str.startswith("control_").to_numpy()
        assert areas[perm] == pytest.approx(permutations.area(pos, neg, own["p_raw"].to_numpy()), abs=1e-6)


def test_a_label_that_needs_a_row_takes_the_ordered_pass(rows, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 1)
    assert permutations._sides(rows.sparkSession, matrix(rows), F.col("row") > 3) is None
    known = permutations._sides(rows.sparkSession, matrix(rows), F.when(F.col("stratum") == "ptsd", True).when(F.col("y") == 0, False))
    assert known["ptsd", 0.0] is True and known["control_A", 0.0] is False and known["control_A", 1.0] is None


def test_candidate_frequency_counts_outer_folds_of_long_parts(rows, monkeypatch):
    few = nested.replace(PROTOCOL, candidates=CANDIDATES[:4])
    count = lambda: {r["candidate"]: r["n"] for r in nested.candidate_frequency(nested.nested_oof(rows, few)).collect()}
    plain = count()
    monkeypatch.setattr(parts, "PART_ROWS", 1)
    monkeypatch.setattr(nested, "inner_oof", None)
    assert count() == plain and sum(plain.values()) == 7
