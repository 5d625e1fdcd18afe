"""Element-wise statistics of array columns per key, without a row an element.

Mean and spread are mergeable (count, mean, sum of squared deviations) arrays: one a key and partition, then one a key. Medians of keys
with few rows are taken in one task; those of large keys come from counting refinement, where each pass over the rows fixes four
more bits of every position's two middle values. Null rows and null or NaN elements are left out; shorter arrays count for the
positions they have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.batched import DIGIT, from_keys, ordered_keys
from sigloom.session import checkpointed

SMALL_ROWS = 10_000
HELD_KEYS = 5_000


def _matrix(values: pd.Series) -> np.ndarray:
    """Rows of equal length, filled with NaN."""
    rows = [np.array(v, dtype=float) for v in values]
    out = np.full((len(rows), max(map(len, rows), default=0)), np.nan)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two (3, positions) tables of count, mean and squared deviations as one."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(width), where=n > 0)
    d = b[1] - a[1]
    return np.stack([n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share])


def _moments(x: np.ndarray) -> np.ndarray:
    n = (~np.isnan(x)).sum(axis=0)
    mean = np.divide(np.nansum(x, axis=0), n, out=np.zeros(x.shape[1]), where=n > 0)
    return np.stack([n, mean, np.nansum((x - mean) ** 2, axis=0)])


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{k} {kinds[k]}, " for k in keys) + rest


def mean_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: ``n``, ``mean`` and ``sem`` (sample deviation over the root of the count) as arrays."""
    keys = list(keys)

    def partial(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        table = lambda: pd.DataFrame([(*k, m.tobytes()) for k, m in held.items()], columns=[*keys, "m"])
        for block in blocks:
            for k, part in block.groupby(keys, dropna=False) if len(block) else ():
                k = tuple(None if pd.isna(v) else v for v in k)
                now = _moments(_matrix(part[value]))
                held[k] = merged(held[k], now) if k in held else now
            if len(held) > HELD_KEYS:
                yield table()
                held.clear()
        if held:
            yield table()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((3, 0))
        for m in pdf["m"]:
            total = merged(total, np.frombuffer(m).reshape(3, -1))
        n, mean, squares = total
        with np.errstate(invalid="ignore", divide="ignore"):
            sem = np.sqrt(squares / (n - 1)) / np.sqrt(n)
        none = lambda x, least: [float(v) if c >= least else None for v, c in zip(x, n)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n.astype(int).tolist()], "mean": [none(mean, 1)], "sem": [none(sem, 2)]})

    parts = df.filter(F.col(value).isNotNull()).select(*keys, value).mapInPandas(partial, _schema(df, keys, "m binary"))
    return parts.groupBy(*keys).applyInPandas(merge, _schema(df, keys, "n array<long>, mean array<double>, sem array<double>"))


def _median(pdf: pd.DataFrame, keys: Sequence[str], value: str) -> pd.DataFrame:
    x = np.sort(_matrix(pdf[value]), axis=0)  # gaps stand last
    n, at = (~np.isnan(x)).sum(axis=0), np.arange(x.shape[1])
    middle = (x[np.maximum(n - 1, 0) // 2, at] + x[np.minimum(n // 2, len(x) - 1), at]) / 2
    out = [float(v) if c else None for v, c in zip(middle, n)]
    return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "median": [out]})


def median(df: DataFrame, keys: Sequence[str], value: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Per key: the exact ``median`` of every position."""
    keys = list(keys)
    rows = checkpointed(df.filter(F.col(value).isNotNull()).select(*keys, value))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size(value)).alias("_w"))
    large = sizes.filter(F.col("_n") > small_rows).orderBy(*keys).collect()  # at most the rows over small_rows keys
    schema = _schema(df, keys, "median array<double>")
    if not large:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: _median(pdf, keys, value), schema)
    names = rows.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], _schema(df, keys, "")[:-2])
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    match = same[0]
    for s in same[1:]:
        match = match & s
    few = rows.alias("r").join(F.broadcast(names.alias("l")), match, "left_anti")
    out = few.groupBy(*keys).applyInPandas(lambda pdf: _median(pdf, keys, value), schema)
    many = checkpointed(rows.alias("r").join(F.broadcast(names.alias("l")), match, "left_semi"))
    return out.unionByName(_refined(many, keys, value, large, schema))


def _refined(rows: DataFrame, keys: list[str], value: str, large: list, schema: str) -> DataFrame:
    spark, width, ways = rows.sparkSession, max(r["_w"] for r in large), 1 << DIGIT
    at = {tuple(r[k] for k in keys): i for i, r in enumerate(large)}

    def summed(columns: int, part) -> np.ndarray:  # noqa: ANN001
        """Sum over the rows of a key of an array (position, columns)."""

        def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for block in blocks:
                for k, own in block.groupby(keys, dropna=False) if len(block) else ():
                    i = at[tuple(None if pd.isna(v) else v for v in k)]
                    x = _matrix(own[value])
                    x = np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan)
                    held[i] = held.get(i, 0) + part(i, x)
            if held:
                yield pd.DataFrame({"k": list(held), "v": [a.tobytes() for a in held.values()]})

        add = lambda pdf: pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})
        out = np.zeros((len(large), width, columns))
        for r in rows.mapInPandas(run, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect():
            out[r["k"]] = np.frombuffer(bytes(r["v"])).reshape(width, columns)
        return out

    count = summed(1, lambda i, x: (~np.isnan(x)).sum(axis=0, dtype=float)[:, None])[:, :, 0]
    wanted = np.stack([(count - 1) // 2, count // 2], axis=-1) + 1
    prefix = np.zeros((len(large), width, 2), np.uint64)
    for low in range(64 - DIGIT, -1, -DIGIT):
        bounds = prefix[..., None] | (np.arange(ways - 1, dtype=np.uint64) << np.uint64(low)) | np.uint64((1 << low) - 1)

        def part(i: int, x: np.ndarray, bounds=bounds) -> np.ndarray:
            out = np.zeros((width, 2 * (ways - 1)))
            for j in range(width):
                own = np.sort(ordered_keys(x[~np.isnan(x[:, j]), j]))
                out[j] = np.searchsorted(own, bounds[i, j].ravel(), side="right")
            return out

        reached = summed(2 * (ways - 1), part).reshape(len(large), width, 2, ways - 1)
        prefix |= (reached < wanted[..., None]).sum(axis=-1).astype(np.uint64) << np.uint64(low)
    values = from_keys(prefix).mean(axis=-1)
    made = [(*[r[k] for k in keys], [float(v) if c else None for v, c in zip(values[i, : r["_w"]], count[i])]) for i, r in enumerate(large)]
    return spark.createDataFrame(made, schema)
