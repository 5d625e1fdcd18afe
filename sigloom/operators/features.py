"""Per-subject features from flagged windows, and the batch-scoring job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import fingerprint as fp
from sigloom.operators import learn, recordings, spectral, windows
from sigloom.session import checkpointed
from sigloom.sinks.single_file import write_csv
from sigloom.sources import edf

CH = edf.CHANNELS
OCCIPITAL = ("O1", "O2")
TASK_CHANNELS = ("O1", "Fp1", "Fp2")
SEGMENT_WINDOWS = 9
GRID = spectral.Grid(500, edf.TARGET_SFREQ)


def feature_names() -> tuple[str, ...]:
    """The fixed order of the subject features."""
    names = [f"{cond}_relpow_{band}_{ch}" for cond in ("rest", "task") for band in spectral.BANDS for ch in CH]
    names += ["rest_iaf_occ", "rest_alpha_peak_occ", "alpha_reactivity_occ"]
    names += [f"rest_exponent_{ch}" for ch in CH] + ["rest_iaf_O1", "rest_alpha_peak_O1"]
    names += [f"rest_relpow20_{band}_{ch}" for band in spectral.BANDS_20 for ch in CH]
    names += [f"rest_slope20_{ch}" for ch in CH] + ["rest_iaf20_O1", "rest_alpha_peak20_O1", "rest_faa"]
    return tuple(names)


FEATURE_NAMES = feature_names()


def with_psd(flagged: DataFrame, sfreq: float = edf.TARGET_SFREQ) -> DataFrame:
    """Power arrays of the retained windows; the samples are dropped."""
    return flagged.filter("reject = 0").withColumn("psd", signal.psd(F.col("x"), sfreq)).drop("x")


def _mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the columns that are present."""
    have = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have))


def frontal_asymmetry(power: DataFrame, key: str = "subject_key", min_windows: int = spectral.MIN_GOOD_WINDOWS) -> DataFrame:
    """Mean of ln alpha(Fp2) - ln alpha(Fp1) over rest windows retained on both channels."""
    alpha = GRID.integrals(F.col("psd"), [spectral.BANDS["alpha"]])[0]
    rest = power.filter((F.col("condition") == "rest") & F.col("channel").isin("Fp1", "Fp2")).select(key, "path", "window_idx", "channel", alpha.alias("a"))
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("a")))
    both = rest.groupBy(key, "path", "window_idx").agg(pick("Fp1").alias("l"), pick("Fp2").alias("r")).filter("l > 0 AND r > 0")
    out = both.groupBy(key).agg(F.avg(F.ln("r") - F.ln("l")).alias("rest_faa"), F.count(F.lit(1)).alias("_n"))
    return out.filter(F.col("_n") >= min_windows).select(key, "rest_faa")


def subject_features(power: DataFrame, subjects: DataFrame, key: str = "subject_key") -> DataFrame:
    """All features per subject; ``power`` carries the key, ``condition``, ``path``, ``channel``, ``window_idx`` and ``psd``."""
    least = F.when(F.col("condition") == "task", spectral.MIN_TRIAL_WINDOWS).otherwise(1)
    pooled = spectral.condition_spectrum(power, [key, "condition", "channel"], "path", min_record_windows=least)
    pick = [
        F.max(F.when((F.col("condition") == cond) & (F.col("channel") == ch), F.col("spectrum"))).alias(f"_{cond}_{ch}")
        for cond in ("rest", "task") for ch in CH
    ]
    wide = pooled.groupBy(key).agg(*pick)
    wide = wide.withColumns({f"_log_{ch}": spectral.log10_array(F.col(f"_rest_{ch}")) for ch in CH})
    o1, o2 = (F.col(f"_log_{ch}") for ch in OCCIPITAL)
    wide = wide.withColumn("_log_occ", F.coalesce(F.zip_with(o1, o2, lambda a, b: (a + b) / 2), o1, o2))

    cols: dict[str, Column] = {}
    for cond in ("rest", "task"):
        for ch in CH:
            for band, value in GRID.relative_logs(F.col(f"_{cond}_{ch}")).items():
                cols[f"{cond}_relpow_{band}_{ch}"] = value
    alpha = lambda cond, ch: GRID.integrals(F.col(f"_{cond}_{ch}"), [spectral.BANDS["alpha"]])[0]
    cols["alpha_reactivity_occ"] = _mean_of([F.log10(alpha("task", ch) / alpha("rest", ch)) for ch in OCCIPITAL])
    for ch in CH:
        log_s = F.col(f"_log_{ch}")
        cols[f"rest_exponent_{ch}"] = GRID.exponent(log_s)
        cols[f"rest_slope20_{ch}"] = GRID.exponent(log_s, spectral.BACKGROUND_FIT_20_HZ)
        for band, value in GRID.relative_logs(F.col(f"_rest_{ch}"), spectral.BANDS_20, spectral.TOTAL_BAND_20).items():
            cols[f"rest_relpow20_{band}_{ch}"] = value
    for tag, column, fit in (("occ", "_log_occ", spectral.BACKGROUND_FIT_HZ), ("O1", "_log_O1", spectral.BACKGROUND_FIT_HZ), ("20", "_log_O1", spectral.BACKGROUND_FIT_20_HZ)):
        wide = GRID.with_alpha_peak(wide, column, f"_peak_{tag}", fit)
    for tag, suffix in (("occ", "_occ"), ("O1", "_O1")):
        cols[f"rest_iaf{suffix}"], cols[f"rest_alpha_peak{suffix}"] = F.col(f"_peak_{tag}.frequency"), F.col(f"_peak_{tag}.height")
    cols["rest_iaf20_O1"], cols["rest_alpha_peak20_O1"] = F.col("_peak_20.frequency"), F.col("_peak_20.height")
    values = wide.select(key, *[cols[n].alias(n) for n in FEATURE_NAMES if n != "rest_faa"])
    out = subjects.select(key).distinct().join(values, key, "left").join(frontal_asymmetry(power, key), key, "left")
    return out.select(key, *FEATURE_NAMES)


def relative_powers_20(power: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log10 relative power of the 4-20 Hz bands per key and task channel."""
    kept = power.filter(F.col("channel").isin(*TASK_CHANNELS))
    pooled = spectral.condition_spectrum(kept, [*keys, "channel"], "path")
    rel = GRID.relative_logs(F.col("spectrum"), spectral.BANDS_20, spectral.TOTAL_BAND_20)
    return pooled.select(*keys, "channel", *[c.alias(b) for b, c in rel.items()])


def behaviour_features(durations: DataFrame, key: str = "subject_key") -> DataFrame:
    """Log solve times of five trials: first, mean, trend, first-trial excess; equal times are templates.

    ``durations`` has one row per usable task record: key, ``trial`` (1-5), ``active_duration_s``.
    """
    d = F.col("active_duration_s")
    base = durations.filter(d.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), ((F.count(F.lit(1)) >= 2) & (F.max(d) == F.min(d))).alias("_same"),
        F.max(F.when(F.col("trial") == 1, F.log10(d))).alias("_first"), F.avg(F.log10(d)).alias("_mean"),
        F.regr_slope(F.log10(d), F.col("trial").cast("double")).alias("_slope"),
        F.avg(F.when(F.col("trial") > 1, F.log10(d))).alias("_later"), F.max(F.when(F.col("trial") == 1, d)).alias("_t1"), F.sum(d).alias("_sum"),
    )
    fresh, whole = ~F.col("_same"), ~F.col("_same") & (F.col("_n") == 5)
    return base.select(
        key, F.when(fresh, F.col("_first")).alias("beh_log_duration_trial1"), F.when(whole, F.col("_mean")).alias("beh_log_duration_mean"),
        F.when(whole, F.col("_slope")).alias("beh_log_duration_slope"), F.when(whole, F.col("_first") - F.col("_later")).alias("beh_first_trial_excess"),
        F.col("_same").cast("double").alias("beh_templated"), F.when(fresh, F.col("_t1")).alias("trial1_s"), F.when(whole, F.col("_sum")).alias("total_s"),
        F.when(fresh, F.col("_n")).otherwise(F.lit(0)).cast("double").alias("n_trials"),
    )


def task_features(power: DataFrame, durations: DataFrame, subjects: DataFrame, key: str = "subject_key") -> DataFrame:
    """Behaviour plus EEG of the first windows of each trial: level, reactivity against rest, trend over trials."""
    bands = tuple(spectral.BANDS_20)
    rest = relative_powers_20(power.filter("condition = 'rest'"), [key])
    trials = relative_powers_20(power.filter((F.col("condition") == "task") & (F.col("window_idx") < SEGMENT_WINDOWS)), [key, "trial"])
    first = trials.filter("trial = 1").drop("trial")
    value = lambda b, ch: F.max(F.when(F.col("channel") == ch, F.col(b)))
    level = first.groupBy(key).agg(*[value(b, ch).alias(f"eeg_trial1_{b}_{ch}") for b in bands for ch in TASK_CHANNELS])
    base = rest.groupBy(key).agg(*[value(b, ch).alias(f"_r_{b}_{ch}") for b in bands for ch in TASK_CHANNELS])
    series = trials.groupBy(key, "trial").agg(value("alpha", "O1").alias("alpha_O1"), F.avg(F.when(F.col("channel") != "O1", F.col("theta"))).alias("theta_Fp"))
    x = F.col("trial").cast("double")
    trend = series.groupBy(key).agg(*[F.when(F.count(s) == 5, F.regr_slope(F.col(s), x)).alias(f"eeg_slope_{s}") for s in ("alpha_O1", "theta_Fp")])
    out = subjects.select(key).distinct()
    for part in (behaviour_features(durations, key), level, base, trend):
        out = out.join(part, key, "left")
    react = {f"eeg_react1_{b}_{ch}": F.col(f"eeg_trial1_{b}_{ch}") - F.col(f"_r_{b}_{ch}") for b in bands for ch in TASK_CHANNELS}
    return out.withColumns(react).withColumn("beh_templated", F.coalesce("beh_templated", F.lit(0.0))).drop(*[f"_r_{b}_{ch}" for b in bands for ch in TASK_CHANNELS])


def usable_records(registry: DataFrame) -> DataFrame:
    """Readable records after the within-subject ambiguity policy, with the reason for those dropped."""
    ok = registry.filter("status = 'ok'")
    return fp.resolve_ambiguous(ok, "subject_key", "trial", "content_hash", F.col("condition") == "rest")


def window_power(registry: DataFrame, cfg: recordings.Conditioning = recordings.Conditioning()) -> DataFrame:
    """Power arrays of all retained windows of the usable records."""
    usable = checkpointed(usable_records(registry).filter("usable"))
    flagged = recordings.flagged_windows(usable.select("path", "file_bytes"), cfg)
    attributes = usable.select("path", "subject_key", "condition", "trial")
    return checkpointed(with_psd(flagged, cfg.rate_hz).join(attributes, "path"))


def quality_descriptors(flagged: DataFrame, key: str) -> DataFrame:
    """Share of good rest windows and copy flag per channel, one row per key."""
    good, copy = F.avg((F.col("reject") == 0).cast("double")), F.max(windows.has("reject", windows.Reject.COPY).cast("int"))
    table = flagged.groupBy(key, "channel").agg(good.alias("g"), copy.alias("c"))
    pick = lambda v, ch: F.max(F.when(F.col("channel") == ch, F.col(v)))
    return table.groupBy(key).agg(*[pick("g", ch).alias(f"good_{ch}") for ch in CH], *[pick("c", ch).cast("double").alias(f"copy_{ch}") for ch in CH])


def plausibility(flagged: DataFrame, key: str = "path") -> DataFrame:
    """Channel-pair correlations over windows good on all channels, occipital alpha prominence, RMS ratio of T3."""
    pairs = (("O1", "O2"), ("Fp1", "Fp2"), ("T3", "T4"), ("O2", "Fp2"))
    per = flagged.groupBy(key, "window_idx").agg(F.max("reject").alias("worst"), *[F.max(F.when(F.col("channel") == ch, F.col("x"))).alias(ch) for ch in CH])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    kept = per.filter("worst = 0")
    aggs = [F.sum(F.size(CH[0])).alias("n")]
    aggs += [F.sum(total(F.col(ch))).alias(f"s_{ch}") for ch in CH] + [F.sum(dot(F.col(ch), F.col(ch))).alias(f"q_{ch}") for ch in CH]
    aggs += [F.sum(dot(F.col(a), F.col(b))).alias(f"p_{a}_{b}") for a, b in pairs]
    sums = kept.groupBy(key).agg(*aggs)
    n = F.col("n")
    corr = lambda a, b: (n * F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")) / F.sqrt(
        (n * F.col(f"q_{a}") - F.pow(f"s_{a}", 2)) * (n * F.col(f"q_{b}") - F.pow(f"s_{b}", 2))
    )
    out = sums.select(key, *[corr(a, b).alias(f"{a}-{b}") for a, b in pairs])
    power = with_psd(flagged)
    occ = spectral.condition_spectrum(power.filter(F.col("channel").isin(*OCCIPITAL)).withColumn("_r", F.lit(0)), [key, "channel"], "_r")
    occ = occ.groupBy(key).agg(F.avg(GRID.prominence(F.col("spectrum"))).alias("alpha_prominence_occ"))
    return out.join(occ, key, "left")


def score(features: DataFrame, model: learn.LogisticModel, key: str = "subject_id") -> DataFrame:
    """Probability per subject; missing features fall back to the training medians."""
    missing = [n for n in model.feature_names if n not in features.columns]
    filled = features.withColumns({n: F.lit(None).cast("double") for n in missing})
    return filled.select(key, model.safe_probability().alias("ptsd_probability"))


def write_predictions(scored: DataFrame, path: str, key: str = "subject_id") -> None:
    """One CSV file sorted by subject, with byte-order mark and header."""
    write_csv(scored.select(F.col(key).alias("subject_id"), "ptsd_probability"), path, ["subject_id"])


def run_scoring(spark: SparkSession, model: learn.LogisticModel, input_dir: str, out_path: str | None = None) -> DataFrame:
    """Score every subject folder below ``input_dir`` (``group/subject/stem.edf``)."""
    from sigloom.sources import registry as reg

    registry = checkpointed(reg.build_registry(edf.list_files(spark, input_dir)))
    cfg = recordings.VARIANTS[str(model.metadata.get("preprocessing_variant", "native"))]
    power = window_power(registry, cfg)
    subjects = registry.select("subject_key", "subject_id").distinct()
    table = subject_features(power, subjects)
    if any(n.startswith(("beh_", "eeg_")) for n in model.feature_names):
        durations = usable_records(registry).filter("usable AND condition = 'task'").select("subject_key", "trial", "active_duration_s")
        table = table.join(task_features(power, durations, subjects), "subject_key", "left")
    result = score(table.join(subjects, "subject_key"), model)
    if out_path is not None:
        write_predictions(result, out_path)
    return result
