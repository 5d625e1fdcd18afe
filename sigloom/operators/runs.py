"""Runs, masks and their mapping to windows, per ordered key, without one-task keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ordered
from sigloom.session import checkpointed


def with_run_id(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Number the maximal runs of equal ``value`` along ``order``; keeps the bucket column for later scans."""
    rows = ordered.range_bucket(df, order[0], keys, write=False) if ordered.BUCKET not in df.columns else df
    rows = ordered.scan(rows, keys, order, previous={"_before": value})
    start = F.when(F.col("_before") == F.col(value), 0).otherwise(1)
    rows = rows.withColumn("_start", start).drop("_before")
    if ordered.BUCKET in rows.columns:
        rows = checkpointed(rows)  # large tables: do not repeat the first pass for the second
    return ordered.scan(rows, keys, order, {name: F.col("_start")}).drop("_start")


def true_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """One row per run: first and last order value, and length."""
    rows = with_run_id(df.select(*keys, *order, value), keys, order, value)
    return rows.groupBy(*keys, "run").agg(
        F.any_value(value).alias(value), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n")
    )


def edge_runs(runs: DataFrame, keys: Sequence[str], value: str, min_len: int) -> DataFrame:
    """Length of the constant run touching the start and the end of each key, 0 if shorter than ``min_len``."""
    long = lambda n: F.when(n >= min_len, n).otherwise(F.lit(0))
    return runs.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        long(F.min_by("n", "run")).alias("head"),
        long(F.max_by("n", "run")).alias("tail"),
        F.sum(long(F.col("n"))).alias("constant"),
        F.count_if(F.col("n") >= min_len).alias("n_stretches"),
    )


def dilate(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, reach: int, name: str) -> DataFrame:
    """Extend a flag by ``reach`` rows to both sides along ``order``."""
    rows = ordered.range_bucket(df, order[0], keys, write=False)
    rows = ordered.scan(rows, keys, order, position="_pos")
    rows = ordered.with_nearest_flag(rows, keys, "_pos", flag)
    near = (F.col("_pos") - F.col("_last") <= reach) | (F.col("_next") - F.col("_pos") <= reach)
    return rows.withColumn(name, F.coalesce(near, F.lit(False))).drop("_pos", "_last", "_next", ordered.BUCKET)


def overlapping_windows(start: Column, end: Column, width: int, step: int) -> Column:
    """Indices k >= 0 of the windows [k * step, k * step + width) that meet the closed interval [start, end].

    All arguments share one integer unit. An interval yields at most (end - start + width) / step + 1 rows,
    so no interval join is needed.
    """
    first = F.greatest(F.lit(0), F.floor((start - width) / step) + 1)
    last = F.floor(end / step)
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))
