"""Averaged responses, diagnostics, listings and the stream form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import diagnostics, erp
from sigloom.sources import edf, listing
from sigloom.streaming import event_windows


def erp_table(spark, n_subjects=4):
    rng = np.random.default_rng(2)
    t = np.arange(-52, 205) / 256
    rows = []
    for s in range(n_subjects):
        for ch in ("FCz", "FP1", "FP2", "C5", "C6", "O1", "O2"):
            n1 = -2 * np.exp(-0.5 * ((t - 0.1) / 0.02) ** 2) + rng.normal(0, 0.02, t.size)
            mmn = -3 * np.exp(-0.5 * ((t - 0.175) / 0.03) ** 2)
            rows += [(str(s), erp.STANDARD, ch, float(t[0]), 256.0, n1.tolist()), (str(s), erp.DEVIANT, ch, float(t[0]), 256.0, (n1 + mmn).tolist())]
    return spark.createDataFrame(rows, "subject string, bin string, channel string, t0_s double, sfreq double, x array<double>")


def test_erp_summary(spark):
    out = erp.summary(erp_table(spark), erp.VIEWS[:2] + erp.VIEWS[4:5]).toPandas().set_index("view")
    fcz = out.loc["FCz"]
    assert fcz["mmn_window_mean_uv"] == pytest.approx(-3 * 0.68, abs=0.05) and fcz["mmn_window_share_negative"] == 1.0
    assert fcz["difference_extremum_latency_s"] == pytest.approx(0.175, abs=0.004) and fcz["standard_n1_latency_s"] == pytest.approx(0.1, abs=0.004)
    assert abs(out.loc["Fp HP4", "mmn_window_mean_uv"]) < abs(fcz["mmn_window_mean_uv"])
    v = erp.view(erp_table(spark), 1)
    assert set(r["channel"] for r in v.select("channel").distinct().collect()) == set(erp.SITES)


def test_resampled_keeps_a_sine():
    t = np.arange(512) / 256
    y = erp.resampled(np.sin(2 * np.pi * 10 * t)[None], 256.0)[0]
    at = np.arange(y.size) / 125
    assert y.size == 250 and np.abs(y - np.sin(2 * np.pi * 10 * at))[20:-20].max() < 0.02


def test_highpass_order_is_recovered(spark):
    f = np.arange(1, 200) / 16
    for n in (1, 2, 4):
        log10_psd = 1.0 - 1.5 * np.log10(f) + 2 * np.log10(np.abs(signal.butter_highpass_response(f, n, 2.0)))
        df = spark.createDataFrame(pd.DataFrame({"freq": f, "log10_psd": log10_psd}))
        best = diagnostics.highpass_order_fit(df).orderBy("ssr").first()
        assert best["order"] == n and best["chi"] == pytest.approx(1.5) and best["c"] == pytest.approx(1.0)


def test_lowfreq_spectrum_is_unbiased_for_white_noise(spark):
    rng = np.random.default_rng(6)
    content = [edf.encode(np.round(rng.normal(0, 10, (6, 240 * 125)) / 0.05), edf.CHANNELS, 125, -0.05 * 32768, 0.05 * 32767) for _ in range(3)]
    files = spark.createDataFrame([(f"r{i}", len(c), bytearray(c)) for i, c in enumerate(content)], "path string, file_bytes long, content binary")
    out = diagnostics.lowfreq_spectrum(files).filter("freq BETWEEN 1 AND 60").agg(F.avg("psd").alias("m")).first()
    assert out["m"] == pytest.approx(100 / 62.5, rel=0.1)


def test_listing_selection(spark, tmp_path):
    keys = ["A/s1/x.edf", "A/s1/y.edf", "A/s2/x.edf", "A/s3/x.edf", "B/s9/x.edf", "readme.txt", "A/s1/deep/z.edf"]
    body = "".join(f"<Contents><Key>{k}</Key><Size>{10 + i}</Size></Contents>" for i, k in enumerate(keys))
    (tmp_path / "l.xml").write_text(f"<ListBucketResult>{body}</ListBucketResult>", encoding="utf-8")
    rows = listing.read_listing(spark, str(tmp_path / "l.xml"))
    pick = lambda **k: sorted(r["key"] for r in listing.select_files(rows, **k).collect())
    assert pick() == sorted(keys[:5]) and pick(group="A", limit_subjects=2) == keys[:3] and pick(limit_subjects=1) == [keys[0], keys[1], keys[4]]
    have = spark.createDataFrame([(keys[0], 10), (keys[1], 99)], "key string, size long")
    assert listing.missing_or_changed(listing.select_files(rows, limit_subjects=1), have).count() == 2


def test_stream_and_batch_windows_agree(spark, tmp_path):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=200, freq="17min"), "event_type": ["a", "b"] * 100, "value": np.arange(200.0)})
    df = spark.createDataFrame(pdf)
    df.write.parquet(str(tmp_path / "in"))
    stream = event_windows.sliding(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = ["event_type", "window_start"]
    got = spark.table("win").toPandas().sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(got, event_windows.sliding(df).toPandas().sort_values(key, ignore_index=True))


def test_power_summary_counts_what_passes_the_null(spark):
    means = ("grid_r", "deviant_found", "phase_within_50ms", "phase_within_50ms_of_bias", "phase_bias_s", "n_records")
    rows = [("v", float(a), float(i), 0.1 * i, *[0.5] * len(means)) for a in (0, 1) for i in range(4)]
    reps = spark.createDataFrame(rows, "variant string, amplitude double, deviant_r double, curve_energy double, " + ", ".join(f"{m} double" for m in means))
    nulls = spark.createDataFrame([("v", 0.0, 9.0, 9.0), ("v", 1.0, 1.5, 0.05)], "variant string, amplitude double, deviant_r_q95 double, curve_energy_q95 double")
    out = {r["amplitude"]: r for r in diagnostics.summarize_power(reps, nulls, 2.0).collect()}
    assert (out[0.0]["test2_power"], out[1.0]["test2_power"], out[1.0]["test3_power"], out[1.0]["difference_rms_uv"]) == (0.0, 0.5, 0.75, 2.0)
