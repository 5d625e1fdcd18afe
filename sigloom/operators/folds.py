"""Group-aware folds, dense indices and seeded draws, all from hashes of keys.

A hash of (seed, key) replaces a random stream: any task can compute it again after a failure, and no task
has to see all keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ordered

ORDER_BYTES = 7

def hash_number(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**32) from the first eight hex digits of an md5 of the parts joined by '|'."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def _order_bucket(df: DataFrame, key: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Bucket that follows the order of ``key``: quantiles of numbers, or of the bytes of strings behind what all begin with."""
    if dict(df.dtypes)[key] != "string":
        return ordered.range_bucket(df, key, within, name)
    df, small = ordered.settle(df, within)
    if small:
        return df
    low, high = (bytes(v or b"") for v in df.agg(F.min(F.col(key).cast("binary")), F.max(F.col(key).cast("binary"))).first())
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    digits = F.rpad(F.hex(F.substring(F.col(key).cast("binary"), shared + 1, ORDER_BYTES)), 2 * ORDER_BYTES, "0")
    numbered = df.withColumn("_order", F.conv(digits, 16, 10).cast("long"))
    return ordered.range_bucket(numbered, "_order", within, name, ordered.bucket_levels(df, df.count())).drop("_order")


def _hash_bucket(df: DataFrame, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Bucket by the leading bits of the hash column ``_h``, as many as the rows need."""
    df, small = ordered.settle(df, within)
    return df if small else df.withColumn(name, F.floor(F.col("_h") / F.lit(2 ** (32 - ordered.bucket_levels(df, df.count())))))


def dense_index(keys: DataFrame, key: str, within: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """0-based position of each distinct key in key order, and the number of keys."""
    rows = _order_bucket(keys.select(*within, key).distinct(), key, ordered.BUCKET, within)
    rows = ordered.scan(rows, list(within), [key], {"__at": F.lit(1).cast("long")}, {f"{name}_count": "__at"})
    return rows.select(*within, key, (F.col("__at") - 1).alias(name), f"{name}_count")


def shuffled_index(keys: DataFrame, key: str, seed: int | Column, within: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """0-based position of each distinct key in the order of its hash: a seeded permutation."""
    rows = keys.select(*within, key).distinct().withColumn("_h", hash_number(seed, F.col(key)))
    rows = ordered.scan(_hash_bucket(rows, ordered.BUCKET, within), list(within), ["_h", key], {"__at": F.lit(1).cast("long")}, {f"{name}_count": "__at"})
    return rows.select(*within, key, (F.col("__at") - 1).alias(name), f"{name}_count")


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """One fold per group, stratified: groups with the same label counts are dealt out in hash order.

    Groups of one composition differ only by name, so dealing each composition round-robin keeps label shares
    even. The deal continues from one composition to the next, which keeps the fold sizes even as well.
    """
    return deal_groups(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n")), group, label, k, seed, name)


def deal_groups(counts: DataFrame, group: str, label: str, k: int = 5, seed: int = 42, name: str = "fold", within: Sequence[str] = ()) -> DataFrame:
    """``stratified_group_folds`` from the label counts ``_n`` of the groups; ``within`` names keys that are dealt independently."""
    within = list(within)
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col(label).cast("string"), F.col("_n").cast("string"))))
    # the list has one entry per label value of a group
    shape = counts.groupBy(*within, group).agg(F.array_join(parts, ",").alias("_shape"))
    shape = shape.withColumn("_shape", F.md5("_shape")).withColumn("_h", hash_number(seed, F.col(group)))
    shape = _hash_bucket(shape, ordered.BUCKET, [*within, "_shape"])
    rows = ordered.scan(shape, [*within, "_shape"], ["_h", group], position="_seat").drop(ordered.BUCKET)
    sizes = shape.groupBy(*within, "_shape").agg(F.count(F.lit(1)).alias("_size"))
    offsets = ordered.scan(_order_bucket(sizes, "_shape", ordered.BUCKET, within), within, ["_shape"], {"_upto": F.col("_size")})
    rows = rows.join(offsets.select(*within, "_shape", (F.col("_upto") - F.col("_size")).alias("_before")), [*within, "_shape"])
    return rows.select(*within, group, F.pmod(F.col("_before") + F.col("_seat") - 1, F.lit(k)).cast("int").alias(name))
