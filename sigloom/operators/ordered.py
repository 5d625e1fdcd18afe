"""Ordered computations that never put one whole key into one task.

Ranks, running sums, neighbours and exact quantiles normally need ``OVER (PARTITION BY key ORDER
BY v)``, which sends every row of a key to a single task. Here the ordered column is first cut into
buckets at approximate quantiles. A bucket depends only on the value, so ties stay together and the
results do not depend on how good the cut is. Windows then run inside (key, bucket), and the small
table of bucket summaries carries totals or edge rows from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import checkpointed

BUCKET = "_bucket"
MIN_LEVELS, MAX_LEVELS = 4, 20
BUCKET_ROWS = 200_000
SMALL_ROWS = 500_000


def bucket_levels(df: DataFrame, rows: int) -> int:
    """log2 of the bucket count: two buckets per shuffle partition, more where a bucket would pass ``BUCKET_ROWS``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_LEVELS, min(MAX_LEVELS, max((2 * parts - 1).bit_length(), (rows // BUCKET_ROWS).bit_length())))


def _fits(df: DataFrame, keys: Sequence[str], small_rows: int | None) -> bool:
    """Whether every key (or the whole table) stays within what one ordered task may hold."""
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    if df.count() <= small_rows:
        return True
    if not keys:
        return False
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= small_rows


def settle(df: DataFrame, keys: Sequence[str] = (), small_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Write an aggregated table once and tell whether its largest key is small enough for one ordered task.

    Everything ordered reads its input several times (edges, totals, rows); the table behind it is computed once.
    """
    done = checkpointed(df)
    return done, _fits(done, keys, small_rows)


def range_bucket(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = BUCKET, levels: int | None = None, write: bool = True, small_rows: int | None = None
) -> DataFrame:
    """Add ``name``: the quantile bucket of column ``value`` (binary search over a few edges).

    Tables whose largest key has at most ``small_rows`` rows stay without buckets, which ``scan`` takes as a single
    bucket. With ``write=False`` the rows are only counted (for plain table scans, where a second read beats a copy).
    """
    if levels is None:
        if write:
            df, small = settle(df, keys, small_rows)
        else:
            small = _fits(df, keys, small_rows)
        if small:
            return df
    k = levels or bucket_levels(df, df.count())
    shares = [i / 2**k for i in range(1, 2**k)]
    edges = df.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), F.lit(20 * 2**k)).alias("_edges"))
    steps = F.array(*[F.lit(2**i) for i in reversed(range(k))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda i, step: F.when(F.get(F.col("_edges"), i + step - 1) < F.col(value), i + step).otherwise(i),
    )
    # one row of 2**k - 1 numbers
    return df.crossJoin(F.broadcast(edges)).withColumn(name, found).drop("_edges")


def _parts(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    totals: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    position: str | None = None,
    bucket: str = BUCKET,
) -> DataFrame:
    """Running sums, neighbours and row numbers per key in one window pass and one summary join.

    ``bucket`` must come from ``range_bucket`` on the first order column. ``sums`` maps new name -> value
    (inclusive running sum), ``totals`` new name -> name in ``sums`` (sum over the whole key), ``previous`` and
    ``following`` new name -> source column, and ``position`` names the 1-based row number.
    """
    sums, totals, previous, following = dict(sums or {}), totals or {}, previous or {}, following or {}
    if position:
        sums[position] = F.lit(1).cast("long")
    if bucket not in df.columns:
        return _scan_small(df, keys, order, sums, totals, previous, following)
    pack = lambda cols: F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols.values())])
    rank = F.struct(*[F.col(o) for o in order])
    aggs = [F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())]
    aggs += [F.max_by(pack(previous), rank).alias("__prev")] if previous else []
    aggs += [F.min_by(pack(following), rank).alias("__next")] if following else []
    over = _parts(keys).orderBy(bucket)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))]
    cols += [F.sum(f"__t{list(sums).index(src)}").over(_parts(keys)).alias(name) for name, src in totals.items()]
    cols += [F.lag("__prev").over(over).alias("__cp")] if previous else []
    cols += [F.lead("__next").over(over).alias("__cn")] if following else []
    # at most one row per key and bucket
    carry = df.groupBy(*keys, bucket).agg(*aggs).select(*keys, bucket, *cols)

    local = _parts([*keys, bucket]).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns(
        {f"__s{i}": F.sum(c).over(upto) for i, c in enumerate(sums.values())}
        | ({"__lp": F.lag(pack(previous)).over(local)} if previous else {})
        | ({"__ln": F.lead(pack(following)).over(local)} if following else {})
    ).join(carry, [*keys, bucket])
    made = {name: F.col(f"__s{i}") + F.col(f"__o{i}") for i, name in enumerate(sums)}
    made |= {name: F.coalesce("__lp", "__cp").getField(f"c{i}") for i, name in enumerate(previous)}
    made |= {name: F.coalesce("__ln", "__cn").getField(f"c{i}") for i, name in enumerate(following)}
    temp = ("__lp", "__cp", "__ln", "__cn", *[f"__{k}{i}" for k in "so" for i in range(len(sums))])
    return out.withColumns(made).drop(*temp)


def _scan_small(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], totals: dict[str, str], previous: dict[str, str], following: dict[str, str]
) -> DataFrame:
    """``scan`` of a size-checked table: plain windows per key."""
    local = _parts(keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    made = {name: F.sum(c).over(upto) for name, c in sums.items()}
    made |= {name: F.sum(sums[src]).over(_parts(keys)) for name, src in totals.items()}
    made |= {name: F.lag(src).over(local) for name, src in previous.items()}
    made |= {name: F.lead(src).over(local) for name, src in following.items()}
    return df.withColumns(made)


def with_nearest_flag(
    df: DataFrame, keys: Sequence[str], position: str, flag: Column, bucket: str = BUCKET
) -> DataFrame:
    """Add ``_last`` / ``_next``: positions of the nearest flagged row at or before / at or after each row."""
    near = df.withColumn("_at", F.when(flag, F.col(position)))
    if bucket not in df.columns:
        local = _parts(keys).orderBy(position)
        near = near.withColumn("_last", F.max("_at").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        return near.withColumn("_next", F.min("_at").over(local.rowsBetween(0, Window.unboundedFollowing))).drop("_at")
    ends = near.groupBy(*keys, bucket).agg(F.max("_at").alias("_hi"), F.min("_at").alias("_lo"))
    over = _parts(keys).orderBy(bucket)
    ends = ends.select(
        *keys,
        bucket,
        F.max("_hi").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi"),
        F.min("_lo").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_lo"),
    )
    local = _parts([*keys, bucket]).orderBy(position)
    near = near.withColumn("_last", F.max("_at").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_next", F.min("_at").over(local.rowsBetween(0, Window.unboundedFollowing)))
    return (
        near.join(ends, [*keys, bucket])
        .withColumn("_last", F.coalesce("_last", "_hi"))
        .withColumn("_next", F.coalesce("_next", "_lo"))
        .drop("_at", "_hi", "_lo")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with summed weights: repeated values shrink before any ordering."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of ``value`` within keys, ties sharing their mean rank."""
    counts = value_counts(df, keys, value, {"_n": F.count(F.lit(1))})
    ranks = scan(range_bucket(counts, value, keys), keys, [value], {"_cum": F.col("_n")})
    ranks = ranks.select(*keys, value, (F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*keys, value])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key without holding a key's values in one task.

    ``shares`` maps output column -> probability. NULL values are ignored; keys with none are absent.
    """
    counts = value_counts(df, keys, value, {"_n": F.count(F.lit(1))})
    joined = scan(range_bucket(counts, value, keys), keys, [value], {"_cum": F.col("_n")}, {"_total": "_cum"})
    aggs = []
    for name, share in shares.items():
        spot = (F.col("_total") - 1) * F.lit(float(share))
        # a value covers the 0-based positions [_cum - _n, _cum - 1]
        covers = lambda p: (F.col("_cum") - F.col("_n") <= p) & (F.col("_cum") - 1 >= p)
        aggs += [
            F.max(F.when(covers(F.floor(spot)), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(covers(F.ceil(spot)), F.col(value))).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
    out = joined.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).cast("double").alias(n)
        for n in shares
    ]
    return out.select(*keys, *cols)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def aucs(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, negatives: dict[str, Column], weight: Column | None = None
) -> DataFrame:
    """ROC-AUC per key of the positives against each named set of negatives, in one ordered pass.

    Ties count one half; a key without one of the classes gives NULL. ``weight`` multiplies rows.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    mass = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    used = positive
    for c in negatives.values():
        used = used | c
    sums = {"_p": mass(positive)} | {f"_q{i}": mass(c) for i, c in enumerate(negatives.values())}
    counts = value_counts(df.filter(used), keys, score, sums)
    counts = scan(range_bucket(counts, score, keys), keys, [score], {f"_u{i}": F.col(f"_q{i}") for i in range(len(negatives))})
    won = [F.sum(F.col("_p") * (F.col(f"_u{i}") - 0.5 * F.col(f"_q{i}"))) for i in range(len(negatives))]
    total = counts.groupBy(*keys).agg(F.sum("_p").alias("_p"), *[c.alias(f"_w{i}") for i, c in enumerate(won)], *[F.sum(f"_q{i}").alias(f"_q{i}") for i in range(len(negatives))])
    area = lambda i: F.when((F.col("_p") > 0) & (F.col(f"_q{i}") > 0), F.col(f"_w{i}") / (F.col("_p") * F.col(f"_q{i}")))
    return total.select(*keys, *[area(i).alias(n) for i, n in enumerate(negatives)])


def auc(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, weight: Column | None = None, name: str = "auc"
) -> DataFrame:
    """ROC-AUC per key of the rows where ``positive`` is true against those where it is false (not NULL)."""
    return aucs(df, keys, score, F.coalesce(positive, F.lit(False)), {name: F.coalesce(~positive, F.lit(False))}, weight)
