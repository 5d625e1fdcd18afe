"""EDF files on disk through decoding, conditioning, flags, features and scoring."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import cycles, features, learn, recordings, spectral, windows
from sigloom.operators.windows import Reject
from sigloom.sources import edf, registry

STEP = 4000 / 65535


def noise(seed, seconds, sfreq=125, sd=20.0, n=6):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, sd, (n, seconds * sfreq)) / STEP).astype(np.int64).clip(-32768, 32767)


def write(path, data, sfreq=125, labels=edf.CHANNELS):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(edf.encode(data, labels, sfreq, -2000, 2000))
    return path


def table(spark, *paths):
    return spark.createDataFrame([(str(p), p.stat().st_size) for p in paths], "path string, file_bytes long")


def test_decode_restores_digital_samples_in_requested_order(spark, tmp_path):
    data = noise(0, 7)
    p = write(tmp_path / "a.edf", data, labels=("EEG O1", "t3", "Fp1", "Fp2", "T4", "O2"))
    for per_piece in (100, 10_000):
        got = edf.samples(table(spark, p), channels=("Fp2", "O1"), per_piece=per_piece).orderBy("start").collect()
        for ch, i in (("Fp2", 3), ("O1", 0)):
            assert np.array_equal(np.concatenate([r["digital"] for r in got if r["channel"] == ch]), data[i])
    row = edf.samples(table(spark, p)).select("channel", edf.microvolts().alias("uv")).filter("channel = 'O1'").first()
    np.testing.assert_allclose(row["uv"], (data[0] + 32768) * STEP - 2000, atol=1e-9)


def test_header_status(spark, tmp_path):
    ok = write(tmp_path / "ok.edf", noise(1, 4))
    empty = tmp_path / "empty.edf"
    empty.write_bytes(b"")
    short = tmp_path / "short.edf"
    short.write_bytes(ok.read_bytes()[:600])
    lacking = write(tmp_path / "lacking.edf", noise(1, 4, n=5), labels=edf.CHANNELS[:5])
    cut = tmp_path / "cut.edf"
    cut.write_bytes(ok.read_bytes()[:-100])
    got = {r["path"].split("/")[-1]: r for r in edf.headers(table(spark, ok, empty, short, lacking, cut)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok.edf": "ok", "empty.edf": "empty", "short.edf": "error", "lacking.edf": "error", "cut.edf": "ok"}
    assert got["ok.edf"]["n_records"] == 4 and got["cut.edf"]["n_records"] == 3 and got["cut.edf"]["trailing_bytes"] == 1400


def test_filters_and_resampling():
    taps = signal.fir_taps(125.0, None, 40.0)
    response = np.abs(np.fft.rfft(taps, 4096))
    f = np.fft.rfftfreq(4096, 1 / 125)
    assert response[f < 38].min() > 0.98 and response[f > 51].max() < 0.01
    band = np.abs(np.fft.rfft(signal.fir_taps(125.0, 1.0, 20.0), 8192))
    f = np.fft.rfftfreq(8192, 1 / 125)
    assert band[f < 0.05].max() < 0.02 and abs(band[(f > 3) & (f < 17)] - 1).max() < 0.02 and band[f > 26].max() < 0.01
    for order in (1, 2, 4):
        h = signal.butter_highpass_response(np.array([0.02, 2.0, 200.0]), order, 2.0)
        assert abs(h[1]) == pytest.approx(2**-0.5) and abs(h[2]) == pytest.approx(1, abs=1e-3) and abs(h[0]) < 0.02
        x = np.sin(2 * np.pi * 10 * np.arange(2560) / 256)
        y = signal.butter_highpass(x, 256.0, order, 2.0)
        assert np.abs(y[1280:]).max() == pytest.approx(abs(signal.butter_highpass_response(np.array([10.0]), order, 2.0))[0], abs=0.02)


@pytest.mark.parametrize("sfreq", [125, 250, 256])
def test_conditioning_does_not_depend_on_the_cut(spark, tmp_path, sfreq):
    t = np.arange(30 * sfreq) / sfreq
    data = np.tile(np.round(50 * np.sin(2 * np.pi * 10 * t) / STEP), (6, 1)).astype(int) + noise(2, 30, sfreq, sd=1.0)
    files = table(spark, write(tmp_path / f"s{sfreq}.edf", data, sfreq))
    whole, cut = (
        {(r["window_idx"], r["channel"]): np.array(r["x"]) for r in recordings.conditioned_windows(files, per_piece=k).collect()} for k in (1000, 3)
    )
    assert len(whole) == 14 * 6 and whole.keys() == cut.keys()
    for key in whole:
        np.testing.assert_allclose(whole[key], cut[key], atol=1e-8)
    power = signal.hann_psd(whole[(5, "O1")], 125.0)
    assert np.argmax(power) == 40 and whole[(5, "O1")].std() == pytest.approx(50 / np.sqrt(2), rel=0.03)


def test_flags_hit_the_right_windows(spark, tmp_path):
    data = noise(3, 60)
    data[1, 1900:2600] = 0  # flat T3 around seconds 16-20
    data[2, 4000:4005] = 32767  # rail run on Fp1 at second 32
    data[4, 5000:5250] = (data[4, 5000:5250] * 8).clip(-30000, 30000)  # loud T4 around second 40-42
    data[:, 6000:6100] = data[:, 6000:6001]  # dropout on all channels at 48-48.8
    data[5] = data[0]  # O2 copies O1
    files = table(spark, write(tmp_path / "flags.edf", data))
    both = [recordings.flagged_windows(files, per_piece=k, values=v).select("window_idx", "channel", "reject").orderBy("window_idx", "channel").toPandas() for k, v in ((120, True), (3, True), (5, False))]
    w = both[0]
    assert all(w.equals(other) for other in both[1:])
    hit = {r: {(x.channel, x.window_idx) for x in w.itertuples() if x.reject & int(r)} for r in Reject}
    assert len(w) == 29 * 6
    assert ("T3", 8) in hit[Reject.FLAT] and len(hit[Reject.FLAT]) == 1
    assert hit[Reject.RAIL] == {("Fp1", 14), ("Fp1", 15), ("Fp1", 16)} or hit[Reject.RAIL] == {("Fp1", 14), ("Fp1", 15), ("Fp1", 16), ("Fp1", 13)}
    assert {c for c, _ in hit[Reject.DROPOUT]} == set(edf.CHANNELS) and {i for _, i in hit[Reject.DROPOUT]} == {22, 23, 24}
    assert {c for c, _ in hit[Reject.COPY]} == {"O1", "O2"} and len(hit[Reject.COPY]) == 58
    assert {("T4", 19), ("T4", 20)} <= hit[Reject.VARIANCE] | hit[Reject.AMPLITUDE]
    q = windows.quality_table(recordings.flagged_windows(files), ["channel"]).toPandas().set_index("channel")
    assert q.loc["O1", "n_good"] == 0 and q.loc["O1", "frac_copy"] == 1.0


def test_constant_edges_are_trimmed(spark, tmp_path):
    data = noise(4, 21)
    data[:, -125:] = 7
    data[:, :50] = 3
    files = table(spark, write(tmp_path / "pad.edf", data))
    for per_piece in (75_000, 40):
        e = recordings.outline(files, per_piece=per_piece).edges.first()
        assert (e["head"], e["tail"], e["constant"]) == (50, 125, 175)
    assert recordings.conditioned_windows(files).agg(F.max("window_idx")).first()[0] == 7


def test_spectral_expressions_on_exact_lines(spark):
    grid = features.GRID
    f = np.maximum(grid.freqs, grid.step / 2)
    line = 2.0 - 1.7 * np.log10(f)
    bump = line + 0.8 * np.exp(-0.5 * ((f - 10.0) / 0.4) ** 2)
    df = spark.createDataFrame([(1, line.tolist()), (2, bump.tolist())], "id int, ls array<double>")
    df = grid.with_alpha_peak(grid.with_slope_fit(df, "ls", "fit", 3.0, 30.0, (7.0, 14.0)), "ls", "p")
    power = grid.relative_logs(F.transform("ls", lambda v: F.pow(F.lit(10.0), v)))
    out = df.select("id", grid.exponent(F.col("ls")).alias("e"), F.col("fit.rmse").alias("rmse"), "p", *[c.alias(b) for b, c in power.items()]).orderBy("id").collect()
    assert out[0]["e"] == pytest.approx(1.7) and out[0]["rmse"] == pytest.approx(0, abs=1e-9)
    assert out[0]["p"]["frequency"] is None and out[1]["p"]["frequency"] == pytest.approx(10.0, abs=0.02) and out[1]["p"]["height"] == pytest.approx(0.8, abs=0.02)
    assert sum(10 ** out[1][b] for b in spectral.BANDS) == pytest.approx(1.0)


def test_registry_links_and_scoring(spark, tmp_path):
    base = noise(10, 60)
    control, case = edf.GROUPS[0], edf.GROUPS[1]
    write(tmp_path / control / "a_30" / "T-П.edf", base)
    write(tmp_path / control / "a_30" / "Т-1.EDF", noise(11, 30))  # Cyrillic stem
    write(tmp_path / control / "b_70" / "T-П.edf", noise(12, 60))
    shared = noise(13, 40)
    shared[:, : 10 * 125] = base[:, 20 * 125 : 30 * 125]  # ten seconds of the first subject
    write(tmp_path / case / "c" / "T-П.edf", shared)
    write(tmp_path / case / "d" / "T-П.edf", noise(14, 60))
    write(tmp_path / case / "d" / "T-2.edf", noise(14, 60))  # same content as its rest record
    reg, links, subjects = registry.scan(spark, str(tmp_path))
    assert reg.count() == 4 * 6
    by = {(r["subject_id"], r["stem"]): r for r in reg.collect()}
    assert by[("a_30", "T-1")]["status"] == "ok" and by[("a_30", "T-3")]["status"] == "missing" and by[("b_70", "T-П")]["holdout"]
    assert by[("a_30", "T-П")]["export_family"] == "B" and by[("a_30", "T-П")]["active_duration_s"] == 60.0
    kinds = sorted((r["kind"], r["relpath_a"].split("/")[1], r["relpath_b"].split("/")[1]) for r in links.collect())
    assert kinds == [("identical", "d", "d"), ("overlap", "a_30", "c")]
    s = {r["subject_id"]: r for r in subjects.collect()}
    assert s["a_30"]["split_group"] == s["c"]["split_group"] != s["d"]["split_group"] and s["a_30"]["group_size"] == 2
    assert (s["b_70"]["stratum"], s["c"]["stratum"], s["a_30"]["stratum"]) == ("control_ageing", "ptsd", "control_B")

    names = ("rest_relpow_alpha_O1", "rest_exponent_Fp1", "rest_faa")
    model = learn.LogisticModel(names, (-0.5, 1.0, 0.0), (-0.5, 1.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.5, 2.0), 0.3, calibration=(0.8, 0.1))
    out = features.run_scoring(spark, model, str(tmp_path), str(tmp_path / "out")).toPandas().set_index("subject_id")["ptsd_probability"]
    fallback = 1 / (1 + np.exp(-(0.8 * 0.3 + 0.1)))
    assert len(out) == 4 and out["d"] == pytest.approx(fallback) and out["b_70"] != pytest.approx(fallback)
    want = "\ufeffsubject_id,ptsd_probability\r\n" + "".join(f"{i},{out[i]!r}\r\n" for i in sorted(out.index)).replace("np.float64(", "").replace(")", "")
    assert (tmp_path / "out").read_bytes() == want.encode()


def test_cycle_recovery_of_known_phase_and_position():
    rng = np.random.default_rng(5)
    n, t = 6, np.arange(500) / 125
    onset, position = rng.uniform(0, 0.5, n), rng.integers(0, 8, n)
    spectra = []
    for o, k in zip(onset, position):
        beat = sum(-np.exp(-0.5 * ((((t - o - 0.5 * j - 0.1) + 2) % 4 - 2) / 0.03) ** 2) for j in range(8))
        late = -3 * np.exp(-0.5 * ((((t - o - 0.5 * k - 0.2) + 2) % 4 - 2) / 0.05) ** 2)
        spectra.append(np.fft.rfft(beat + late))
    s = np.array(spectra)
    m = cycles.Agreement(s, s, cycles.BAND_HZ).at(np.zeros(n, dtype=int))
    err = (m["tau_a"] / 500 - onset - 0.5 * position + 2) % 4 - 2
    assert np.abs(err).max() < 0.1 and (m["grid_r"] > 0.99).all() and (m["tau_agreement"] == 1).all()
    moved = cycles.Agreement(s, s, cycles.BAND_HZ).at(np.full(n, 125))
    assert (moved["grid_r"] < 0.9).all()


def test_fingerprints_do_not_depend_on_the_piece_size(spark):
    rng = np.random.default_rng(8)
    content = edf.encode(rng.integers(-100, 100, (6, 125 * 300)), edf.CHANNELS, 125, -800.0, 800.0)
    files = spark.createDataFrame([("a", len(content), bytearray(content))], "path string, file_bytes long, content binary")
    got = {edf.content_hashes(edf.channel_digests(files, per_piece=k)).first()["content_hash"] for k in (75_000, 20_000, 1)}
    assert len(got) == 1


def test_a_path_that_no_reader_takes_is_an_error_row(spark):
    files = spark.createDataFrame([("nosuch://bucket/a.edf", 5000)], "path string, file_bytes long")
    assert edf.headers(files).first()["status"] == "error"


def test_two_files_of_one_stem_are_an_error_where_asked(spark):
    rows = [("x/ПТСР/s1/T-1.edf", 1), ("x/ПТСР/s1/Т-1.EDF", 2), ("x/ПТСР/s2/T-1.edf", 1)]
    files = spark.createDataFrame(rows, "path string, file_bytes long")
    assert {r["n_files"] for r in registry.matched_files(files).collect()} == {1, 2}
    with pytest.raises(Exception, match="several files for ПТСР/s1/T-1"):
        registry.strictly_matched(files).collect()
    assert registry.strictly_matched(files.filter("path LIKE '%s2%'")).count() == 1


def test_no_exchange_carries_samples(spark):
    content = edf.encode(np.random.default_rng(3).integers(-900, 900, (6, 125 * 40)), edf.CHANNELS, 125, -800.0, 800.0)
    files = spark.createDataFrame([("a", len(content), bytearray(content))], "path string, file_bytes long, content binary")
    plan = recordings.flagged_windows(files)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInPandas")]
    assert "Exchange" not in above
    assert not any("Exchange" in line and "array<double>" in line for line in plan.splitlines())


def test_a_file_cut_within_its_samples_is_a_status_row(spark):
    content = [edf.encode(np.round(np.random.default_rng(i).normal(0, 400, (6, 125 * 60))), edf.CHANNELS, 125, -800.0, 800.0) for i in range(3)]
    rows = [(f"r{i}", len(c), bytearray(c if i != 1 else c[: len(c) * 2 // 3])) for i, c in enumerate(content)]
    files = spark.createDataFrame(rows, "path string, file_bytes long, content binary")
    known = recordings.outline(files, per_piece=1000)
    bad = known.quarantine.collect()
    assert {r["path"] for r in bad} == {"r1"} and 1 <= len(bad) <= 4 and all(r["error"] for r in bad)
    assert {r["path"] for r in known.meta.collect()} == {"r0", "r2"}
    whole = recordings.flagged_windows(files.filter("path <> 'r1'")).groupBy("path").agg(F.sum("reject").alias("r"), F.count("*").alias("n")).collect()
    assert sorted(whole) == sorted(recordings.flagged_windows(files).groupBy("path").agg(F.sum("reject").alias("r"), F.count("*").alias("n")).collect()) and len(whole) == 2


def test_broken_recordings_stay_in_the_registry(spark, tmp_path, monkeypatch):
    control = edf.GROUPS[0]
    for k in (1, 2):
        write(tmp_path / control / f"s{k}_30" / "T-П.edf", noise(40 + k, 30))
    listed = edf.list_files(spark, str(tmp_path)).collect()
    path = tmp_path / control / "s1_30" / "T-П.edf"
    path.write_bytes(path.read_bytes()[:20_000])
    files = spark.createDataFrame(listed)
    monkeypatch.setattr(edf, "list_files", lambda *_: files)
    reg, links, subjects = registry.scan(spark, str(tmp_path))
    status = {r["subject_id"]: (r["status"], r["error"]) for r in reg.filter("stem = 'T-П'").collect()}
    assert status["s2_30"] == ("ok", None) and status["s1_30"][0] == "error" and status["s1_30"][1]
    assert subjects.count() == 2 and links.count() == 0


def test_spectra_are_computed_once_a_content(spark, tmp_path):
    from sigloom.operators import spectra_cache
    from sigloom.session import checkpointed

    content = [edf.encode(np.round(np.random.default_rng(i % 3).normal(0, 400, (6, 125 * 60))), edf.CHANNELS, 125, -800.0, 800.0) for i in range(4)]
    files = spark.createDataFrame([(f"r{i}", len(c), bytearray(c)) for i, c in enumerate(content)], "path string, file_bytes long, content binary")
    hashes = edf.content_hashes(edf.channel_digests(files))
    reg = checkpointed(files.join(hashes, "path").withColumn("status", F.lit("ok")))
    folder = str(tmp_path / "spectra")
    cfg = recordings.Conditioning()
    assert spectra_cache.missing(reg, folder, cfg).count() == 3
    one = sorted(map(tuple, spectra_cache.update(reg.filter("path IN ('r0', 'r1')"), folder, cfg).collect()))
    assert len(one) == 12 and len(spectra_cache.committed(spark, folder)) == 1
    plain = {(r["path"], r["channel"]): r for r in spectra_cache.record_spectra(files, cfg).collect()}
    assert all(any(np.allclose(s, r["spectrum"]) and n == r["n_good"] for r in plain.values()) for _, _, _, n, s in one)
    # a batch without the success mark does not count
    spark.createDataFrame([("x", "y", "O1", 1, [1.0])], spectra_cache.SCHEMA).write.parquet(folder + "/batch-broken")
    (tmp_path / "spectra" / "batch-broken" / "_SUCCESS").unlink()
    two = spectra_cache.update(reg, folder, cfg)
    assert two.select("content_hash").distinct().count() == 3 and two.count() == 18 and len(spectra_cache.committed(spark, folder)) == 2
    # nothing is read any more: the files are gone and the plan holds no samples
    lost = reg.withColumns({"content": F.lit(b""), "file_bytes": F.lit(0).cast("long")})
    again = spectra_cache.update(lost, folder, cfg)
    assert "MapInPandas" not in again._jdf.queryExecution().executedPlan().toString() and again.count() == 18
    assert len(spectra_cache.committed(spark, folder)) == 2
    assert spectra_cache.missing(reg, folder, recordings.VARIANTS["requantized"]).count() == 3


def test_condition_curves_and_null_means(spark):
    from sigloom.operators import condition

    rng = np.random.default_rng(7)
    channels, rows, flat = ("Fp1", "Fp2", "O1"), [], {}
    for r in range(6):
        for c in channels:
            for h in (0, 1):
                s = np.fft.rfft(rng.normal(size=500))
                if r == 4:
                    s[cycles.harmonics(cycles.GRID_HZ)] = 0  # no agreement to speak of
                flat[r, c, h] = s
                rows.append((f"p{r}", c, h, 2 if (r, c, h) == (5, "O1", 1) else 9, s.real.tolist(), s.imag.tolist()))
    halves = spark.createDataFrame(rows, "path string, channel string, half int, n_cycles long, re array<double>, im array<double>")
    records = cycles.record_spectra(halves).withColumn("subject", F.when(F.col("path") < "p2", "s0").otherwise(F.concat(F.lit("s"), "path")))
    measures = cycles.record_measures(records)
    m = measures.toPandas().set_index("path")
    assert m["grid_r"].isna().sum() == 1
    curves = condition.aligned_curves(halves, measures).toPandas().set_index(["path", "channel", "kind"])["curve"]
    assert len(curves) == (6 * 3 - 1) * 2
    fine, t = np.arange(cycles.FINE), np.arange(*cycles.EPOCH)
    for (path, channel, kind), got in curves.items():
        bins, mark, gain = (cycles.offbeat(), "tau", cycles.GAIN) if kind == "deviant" else (cycles.harmonics(cycles.GRID_HZ), "onset", 1.0)
        wave = [2 / 500 * (flat[int(path[1]), channel, h][bins] @ np.exp(2j * np.pi * np.outer(bins, fine) / cycles.FINE)).real for h in (0, 1)]
        a, b = (round(m.loc[path, f"{mark}_{x}_s"] * cycles.FINE_HZ) for x in "ab")
        np.testing.assert_allclose(got, 0.5 * gain * (wave[1][(t + a) % cycles.FINE] + wave[0][(t + b) % cycles.FINE]), atol=1e-9)
    g = condition.group_curves(condition.aligned_curves(halves, measures)).filter("kind = 'deviant' AND channel = 'O1'").toPandas().sort_values("time_s")
    per = [np.mean([curves[f"p{r}", "O1", "deviant"] for r in group], axis=0) for group in ((0, 1), (2,), (3,), (4,))]
    np.testing.assert_allclose(g["mean_uv"], np.mean(per, axis=0), atol=1e-9)
    np.testing.assert_allclose(g["sem_uv"], np.std(per, axis=0, ddof=1) / 2, atol=1e-9)
    top = condition.topography(halves, records, 40).toPandas().set_index(["channel", "statistic"])
    assert len(top) == 6 and top.loc[("O1", "grid_r"), "n_records"] == 5 and top["p"].between(1 / 41, 1).all()
    # without a delay the weighted sums are the observed group statistics, also where a record has no agreement
    w = cycles.record_weights(measures).toPandas().set_index("path")["w"]
    observed = cycles.group_statistics(measures).first()
    for i, k in enumerate(cycles.STATS):
        assert observed[k] == pytest.approx(sum(w[p][i] * np.nan_to_num(m.loc[p, k]) for p in m.index))
    assert (cycles.random_delays(np.array([5, 9]), np.arange(300))[0] != cycles.random_delays(np.array([5, 9]), np.arange(300))[1]).mean() > 0.9


def test_headers_take_only_header_bytes_to_python(spark):
    content = edf.encode(np.round(noise(3, 8)).astype(int), edf.CHANNELS, 125, -800.0, 800.0)
    odd = content[:252] + b"six " + content[256:]
    lone = content[:252] + b"9   " + content[256:300]
    df = spark.createDataFrame([("a", len(content), content), ("b", len(odd), odd), ("c", len(lone), lone), ("d", 0, b""), ("e", 7, content[:7])], "path string, file_bytes long, content binary")
    sent = {r["path"]: r["content"] for r in edf._heads(df).collect()}
    assert sent["a"] == content[: edf.BLOCK * (len(edf.CHANNELS) + 1)] and sent["b"] == odd and sent["c"] == lone
    said = {r["path"]: (r["status"], r["n_times"]) for r in edf.headers(df).collect()}
    assert said == {"a": ("ok", 1000), "b": ("error", None), "c": ("error", None), "d": ("empty", None), "e": ("error", None)}


def test_a_piece_brings_only_its_own_records(spark, monkeypatch):
    content = edf.encode(noise(4, 480), edf.CHANNELS, 125, -2000, 2000)
    df = spark.createDataFrame([("a", len(content), content)], "path string, file_bytes long, content binary")
    sent, real = [], edf.pieces
    monkeypatch.setattr(edf, "pieces", lambda *a: sent.append(real(*a)) or sent[-1])
    for step, per_piece in ((edf.samples, 15_000), (edf.channel_digests, 15_000), (recordings.repeat_runs, 15_000), (edf.record_digests, 120)):
        step(df, per_piece=per_piece)
        cut = sent.pop()
        sizes = [sum(r) for r in cut.select(*[F.length(c) for c, kind in cut.dtypes if kind == "binary"]).collect()]
        # its quarter of the samples, the header, and a record in front of it
        assert len(sizes) == 4 and max(sizes) <= len(content) / 4 + edf.BLOCK * 7 + 2 * 6 * 125


def test_pieces_of_odd_contents_read_the_same_samples(spark):
    data = noise(5, 9)
    plain = edf.encode(data, edf.CHANNELS, 125, -2000, 2000)
    at = edf.BLOCK * 7
    gap = plain[:184] + b"2048    " + plain[192:at] + b"\0" * 256 + plain[at:]
    # a number that Python reads and Spark does not, records inside the header, bytes behind the last record, samples missing
    other, early, more, cut = plain[:252] + b"0_6 " + plain[256:], plain[:184] + b"256     " + plain[192:], plain + b"tail", plain[: at + 5000]
    early_data = np.frombuffer(early[256:][: (len(early) - 256) // 1500 * 1500], "<i2").reshape(-1, 6, 125).transpose(1, 0, 2).reshape(6, -1)
    rows = [("plain", plain), ("gap", gap), ("other", other), ("early", early), ("more", more)]
    df = spark.createDataFrame([(k, len(c), bytearray(c)) for k, c in rows], "path string, file_bytes long, content binary").repartition(1)
    for per_piece in (100, 130, 1000):
        got = edf.samples(df, per_piece=per_piece).orderBy("path", "start").collect()
        for k, _ in rows:
            for i, ch in enumerate(edf.CHANNELS):
                found = np.concatenate([r["digital"] for r in got if r["path"] == k and r["channel"] == ch])
                assert np.array_equal(found, (early_data if k == "early" else data)[i]), (k, ch, per_piece)
        flat = recordings.repeat_runs(df, per_piece=per_piece).filter("error IS NOT NULL").count()
        assert flat == 0
    short = spark.createDataFrame([("cut", len(plain), bytearray(cut))], "path string, file_bytes long, content binary")
    bad = {r["piece"]: r["error"] is None for r in recordings.repeat_runs(short, per_piece=300).filter("error IS NOT NULL OR start IS NOT NULL").collect()}
    assert bad == {k: False for k in (1, 2, 3)}




def test_a_task_packs_few_files(spark, monkeypatch):
    from sigloom.plans import recordings as plan
    from sigloom.plans.registry import Tables

    monkeypatch.setattr(plan, "FILES_PER_TASK", 4)
    t = Tables(spark, "unused")
    t.embeddings = spark.range(20 * plan.PER_FILE, numPartitions=1).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5), 64).alias("embedding"))
    per = plan.files(t).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 20 and len(per) > 1


def test_kernels_hold_few_rows_at_a_time():
    import pandas as pd

    whole = pd.DataFrame({"a": range(2 * cycles.RECORDS + 3)})
    cut = list(cycles._few(iter([whole, whole.iloc[:0]])))
    assert [len(c) for c in cut] == [cycles.RECORDS, cycles.RECORDS, 3] and pd.concat(cut)["a"].tolist() == whole["a"].tolist()
    sizes, values = [], pd.Series([np.arange(4.0) + i if i % 7 else None for i in range(3 * signal.STACK_ROWS)])

    def kernel(x):
        sizes.append(len(x))
        return x * 2

    out = signal.stacked(values, kernel)
    assert max(sizes) <= signal.STACK_ROWS and all((o is None) if v is None else (o == 2 * v).all() for o, v in zip(out, values))
