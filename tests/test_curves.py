"""Element-wise statistics, the causal filter in pieces, and the sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import arrays, longfilter


def ragged(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        x = np.round(rng.normal(size=7 if i % 5 else 4), 1).tolist()
        if i % 11 == 0:
            x[2] = None
        if i % 13 == 0:
            x[3] = float("nan")
        rows.append((["a", "b", None][i % 3] if i % 50 else "c", i % 2, x))
    return [*rows, ("a", 0, None), ("d", 0, []), ("e", 1, [None, 1.0])]


def expected(rows):
    groups = {}
    for k, j, x in rows:
        if x is not None:
            groups.setdefault((k, j), []).append([np.nan if v is None else v for v in x])
    out = {}
    for key, xs in groups.items():
        width = max(map(len, xs))
        m = np.full((len(xs), width), np.nan)
        for i, x in enumerate(xs):
            m[i, : len(x)] = x
        out[key] = [c[~np.isnan(c)] for c in m.T]
    return out


def test_mean_and_error_merge(spark, monkeypatch):
    monkeypatch.setattr(arrays, "HELD_KEYS", 1)
    rows = ragged()
    df = spark.createDataFrame(rows, "k string, j int, x array<double>").repartition(5)
    got = {(r["k"], r["j"]): r for r in arrays.mean_sem(df, ["k", "j"], "x").collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for key, columns in want.items():
        assert got[key]["n"] == [len(c) for c in columns]
        for c, mean, sem in zip(columns, got[key]["mean"], got[key]["sem"], strict=True):
            assert mean is None if not len(c) else mean == pytest.approx(c.mean())
            assert sem is None if len(c) < 2 else sem == pytest.approx(c.std(ddof=1) / np.sqrt(len(c)))
    assert arrays.mean_sem(df.filter("false"), ["k"], "x").count() == 0


@pytest.mark.parametrize("small", [10**6, 20, 0])
def test_median_of_every_position(spark, small):
    rows = ragged(4)
    df = spark.createDataFrame(rows, "k string, j int, x array<double>").repartition(3)
    got = {(r["k"], r["j"]): r["median"] for r in arrays.median(df, ["k", "j"], "x", small).collect()}
    want = {k: [float(np.median(c)) if len(c) else None for c in columns] for k, columns in expected(rows).items()}
    assert got == want


def reference_highpass(x, sfreq, order, cutoff):
    y = np.asarray(x, complex)
    for gain, feed in signal._digital_poles(sfreq, order, cutoff):
        out, state, before = [], 0.0, 0.0
        for v in y:
            state = gain * (v - before) + feed * state
            before = v
            out.append(state)
        y = np.array(out)
    return y.real


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_causal_filter_equals_the_recurrence(spark, order):
    x = np.random.default_rng(order).normal(size=1500) + 5
    want = reference_highpass(x, 250.0, order, 0.7) if order else x
    np.testing.assert_allclose(signal.butter_highpass(np.stack([x, -x]), 250.0, order, 0.7), np.stack([want, -want]), atol=1e-8)
    cuts = [0, 1, 2, 400, 401, 900, 900, 1500]
    rows = [(k, i, (s * x[a:b]).tolist()) for k, s in (("u", 1.0), ("v", -2.0)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows, "k string, piece int, x array<double>").repartition(4)
    got = longfilter.highpass_pieces(df, ["k"], "piece", "x", 250.0, order, 0.7).toPandas().sort_values(["k", "piece"])
    for k, s in (("u", 1.0), ("v", -2.0)):
        np.testing.assert_allclose(np.concatenate(got[got["k"] == k]["filtered"].to_list()), s * want, atol=1e-8)


def test_one_sorted_csv_file(spark, tmp_path):
    import csv

    from sigloom.sinks import single_file

    rows = [(f"s{i % 97:03d}-{i}", None if i % 31 == 0 else 1.0 / (i + 3) ** 4) for i in range(800)] + [('quo"te, comma', 0.1), ("two\nlines", 1e-7), ("ü", 1e22), ("Z", 0.5)]
    df = spark.createDataFrame(rows, "subject_id string, ptsd_probability double").repartition(7)
    path = tmp_path / "deep" / "predictions.csv"
    for _ in range(2):  # a second attempt replaces the first
        single_file.write_csv(df, str(path), ["subject_id"])
        want = tmp_path / "want.csv"
        with open(want, "w", newline="", encoding="utf-8-sig") as f:
            w = csv.writer(f)
            w.writerow(["subject_id", "ptsd_probability"])
            w.writerows(sorted(rows, key=lambda r: r[0]))
        assert path.read_bytes() == want.read_bytes()
        assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["predictions.csv"]
    single_file.write_csv(df.filter("false"), str(path), ["subject_id"])
    assert path.read_bytes() == b"\xef\xbb\xbfsubject_id,ptsd_probability\r\n"


def test_slow_spectra_centre_each_segment_once(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(40.0, 1.0, (6, 250))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = df.select("i", signal.psd(F.col("x"), 125.0, centred=True).alias("p")).orderBy("i").toPandas()["p"]
    assert np.allclose(np.stack(got), signal.hann_psd(x - x.mean(axis=1, keepdims=True), 125.0), rtol=1e-9, atol=1e-15)


def test_medians_of_positions_with_gaps():
    rng = np.random.default_rng(6)
    rows = [np.where(rng.random(9) < 0.3, np.nan, rng.normal(size=9)).tolist()[: 9 - i % 3] for i in range(14)]
    got = arrays._median(pd.DataFrame({"k": 1, "v": rows}), ["k"], "v")["median"][0]
    for j in range(9):
        own = [r[j] for r in rows if len(r) > j and not np.isnan(r[j])]
        assert got[j] == (float(np.median(own)) if own else None)
