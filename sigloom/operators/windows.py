"""Windows, detrending, robust outliers and quality flags."""

from __future__ import annotations

from collections.abc import Sequence
from enum import IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ordered

MAD_TO_SIGMA = 1.4826


# The bit of each reason in stored flags
Reject = IntFlag("Reject", [(name, 1 << bit) for bit, name in enumerate(("FLAT", "RAIL", "AMPLITUDE", "VARIANCE", "DROPOUT", "COPY"))], module=__name__)


def flag(condition: Column, reason: Reject) -> Column:
    """Bit of ``reason`` where the condition holds; unknown counts as no."""
    return F.when(condition, F.lit(int(reason))).otherwise(F.lit(0))


def has(flags: str | Column, reason: Reject) -> Column:
    c = F.col(flags) if isinstance(flags, str) else flags
    return c.bitwiseAND(F.lit(int(reason))) > 0


def requantize(x: Column, step: float) -> Column:
    """Round to the grid ``step * k``, halves to even."""
    return F.bround(x / F.lit(float(step)), 0) * F.lit(float(step))


def tumbling(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "cycle") -> DataFrame:
    """Number consecutive groups of ``size`` rows per key from 0; the last may be incomplete."""
    rows = ordered.scan(ordered.range_bucket(df, order[0], keys, write=False), keys, order, position="_pos")
    return rows.withColumn(name, F.floor((F.col("_pos") - 1) / size)).withColumn("slot", (F.col("_pos") - 1) % size).drop("_pos", ordered.BUCKET)


def detrend(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "residual") -> DataFrame:
    """Subtract the least-squares line of each window; the per-window fit is joined back by key."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_m"))
    line = F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.col("_m"))
    return df.join(fit, list(keys)).withColumn(name, F.col(y) - line).drop("_a", "_b", "_m")


def robust_outliers(
    df: DataFrame, keys: Sequence[str], value: str, name: str, usable: Column | None = None, z: float = 3.5, min_rows: int = 5
) -> DataFrame:
    """Upper-tail robust z-score per key from the usable rows; no flag with few rows or zero spread."""
    ref = df if usable is None else df.filter(usable)
    mid = ordered.median(ref, keys, value, "_med")
    spread = ref.join(mid, list(keys)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = ordered.median(spread, keys, "_dev", "_mad")
    size = ref.groupBy(*keys).agg(F.count(value).alias("_ref"))
    stats = mid.join(mad, list(keys)).join(size, list(keys))
    out = df.join(stats, list(keys), "left")
    ok = (F.col("_ref") >= min_rows) & (F.col("_mad") > 0)
    score = (F.col(value) - F.col("_med")) / (MAD_TO_SIGMA * F.col("_mad"))
    return out.withColumn(name, F.coalesce(ok & (score > z), F.lit(False))).drop("_med", "_mad", "_ref")


def quality_table(df: DataFrame, keys: Sequence[str], flags: str = "reject") -> DataFrame:
    """Windows, good windows and the share of windows carrying each flag, per key."""
    shares = [F.avg(has(flags, r).cast("double")).alias(f"frac_{r.name.lower()}") for r in Reject]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col(flags) == 0).alias("n_good"), *shares)


def first_reason(flags: str = "reject") -> Column:
    """Name of the lowest flag that is set, ``ok`` if none."""
    out = F.lit("ok")
    for r in reversed(list(Reject)):
        out = F.when(has(flags, r), r.name.lower()).otherwise(out)
    return out
