"""Permutation test of the whole nested procedure as one job.

Rows keep one shared design matrix, whose size is checked (above the limit permutations run one after the other, each distributed); a permutation only changes labels, strata and inner folds of groups, a
table of permutations times groups. A task runs the complete procedure of one (permutation, outer fold): inner fits of all
candidates, choice, refit, calibration. It sends the predictions of the left-out rows and is done, so no permutation waits for
another; the areas come from one ordered pass over all of them. Where the parts of the table are long, a task takes all outer folds of
a permutation, whose fits share their passes, and can send the area alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import folds, learn, nested, ordered, resample
from sigloom.operators.parts import area, criterion, equal_error_shift, logit, settings  # noqa: F401
from sigloom.session import checkpointed

LABEL_BYTES = 64 << 20


def best_candidate(scores: Sequence[float], protocol: nested.Protocol) -> int:
    """Choice of ``nested.choose``."""
    if protocol.ordered_choice:
        best, top = 0, -np.inf
        for i, s in enumerate(scores):
            if s > top + nested.TIE:
                best, top = i, s
        return best
    return min(range(len(scores)), key=lambda i: (-round(scores[i], 10), protocol.candidates[i].c, i))


def procedure(m: nested._Matrix, outer: int, protocol: nested.Protocol) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Left-out rows, their raw and calibrated probabilities, and the chosen candidate of one outer fold."""
    inside, test = np.flatnonzero(m.outer != outer), np.flatnonzero(m.outer == outer)
    oof = np.full((len(protocol.candidates), len(m.row)), np.nan)
    may = {n: np.ones(len(m.row), bool) if n != "control" else m.stratum != strata.SOMATOFORM for n in nested.NEGATIVES}
    shared = settings(protocol)
    for fold in range(nested.INNER_SPLITS):
        held = inside[m.fold[inside] == fold]
        if not held.size:
            continue
        for features, negatives, weight, mine in shared:
            train = inside[(m.fold[inside] != fold) & may[negatives][inside]]
            found = m.fit_predict(train, held, protocol.feature_sets[features], [protocol.candidates[i].c for i in mine], weight)
            for i, p in zip(mine, found, strict=True):
                oof[i, held] = p
    own = oof[:, inside]
    best = best_candidate([criterion(protocol, m.stratum[inside], p.__getitem__) for p in own], protocol)
    c = protocol.candidates[best]
    raw = next(m.fit_predict(inside[may[c.negatives][inside]], test, protocol.feature_sets[c.features], [c.c], c.spec_weight))
    if not protocol.calibrate:
        return test, raw, raw, best
    y, x = m.y[inside], logit(own[best], 1e-6)
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1))) if protocol.calibration_balanced else np.ones(len(y))
    a, b = learn.solve_local(x[:, None], y, w, learn.PLATT_C)
    if protocol.equal_error:
        b -= equal_error_shift(np.clip(a * x + b, -27.6, 27.6), y == 1, m.specific[inside])
    return test, raw, 1 / (1 + np.exp(-(a * logit(raw, 1e-12) + b))), best


def procedures(m: nested._Matrix, outers: Sequence[int], protocol: nested.Protocol) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``procedure`` of several outer folds of a table in long parts: the outer fold, its parts, and what ``procedure`` says of their rows."""
    shared = settings(protocol)
    models = [nested.inner_models(m, protocol, setting, outers) for setting in shared]
    start = None
    for outer in outers:
        own = {i: [by_c[k] for by_c in found[outer]] for (*_, mine), found in zip(shared, models, strict=True) for k, i in enumerate(mine)}
        names = {i: protocol.feature_sets[protocol.candidates[i].features] for i in own}
        best = best_candidate([nested.inner_score(m, protocol, names[i], outer, own[i]) for i in sorted(own)], protocol)
        raw, line = nested.finished(m, protocol, outer, best, own[best], start=start)
        if line is None:
            yield outer, m.part_outer == outer, raw, raw, best
            continue
        start, (a, b, shift) = line[:2], line
        yield outer, m.part_outer == outer, raw, 1 / (1 + np.exp(-(a * logit(raw, 1e-12) + b - shift))), best


def permuted_strata(df: DataFrame, n_perm: int, seed: int = 42, inside: Column | None = None, moved: Sequence[str] = ("y", "stratum")) -> DataFrame:
    """Per (perm, grp): the labels its rows take (null: their own) and its inner fold under the moved strata."""
    labels = resample.permuted_labels(df, "grp", "row", list(moved), n_perm, seed, inside)
    labels = checkpointed(labels.toDF("perm", "grp", *[f"_{c}" for c in moved]))
    swapped = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    counts = checkpointed(df.groupBy("grp", "stratum", swapped.alias("_in")).agg(F.count(F.lit(1)).alias("_n")))
    every = counts.crossJoin(F.broadcast(df.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("perm")))).join(labels, ["perm", "grp"], "left")
    now = F.when(F.col("_in") & F.col("_stratum").isNotNull(), F.col("_stratum")).otherwise(F.col("stratum")) if "stratum" in moved else F.col("stratum")
    counts = every.groupBy("perm", "grp", now.alias("stratum")).agg(F.sum("_n").alias("_n"))
    dealt = folds.deal_groups(counts, "grp", "stratum", nested.INNER_SPLITS, seed, within=["perm"])
    return dealt.join(labels, ["perm", "grp"], "left").select("perm", "grp", *[f"_{c}" for c in moved], "fold")


def permuted_oof(
    df: DataFrame, protocol: nested.Protocol, n_perm: int, seed: int = 42, inside: Column | None = None, moved: Sequence[str] = ("y", "stratum"), limit: int = nested.BROADCAST_BYTES
) -> DataFrame:
    """Out-of-fold rows of every permutation: ``perm, row, stratum, y, p_raw, p, candidate``."""
    rows, labels = _permuted(df, n_perm, seed, inside, moved)
    if not nested.fits_in_broadcast(rows, protocol, limit):
        return _one_by_one(rows, labels, protocol, n_perm, seed, moved, limit)
    return _in_blocks(nested._matrix(rows, protocol, "_in"), labels, protocol, n_perm, moved, _run)


def _permuted(df: DataFrame, n_perm: int, seed: int, inside: Column | None, moved: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their outer fold and whether their labels move, and the moved labels."""
    rows = df.withColumns({"outer": F.col("grp").cast("long"), "fold": F.lit(0)})
    rows = checkpointed(rows.withColumn("_in", F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))))
    return rows, checkpointed(permuted_strata(rows.drop("outer", "fold"), n_perm, seed, inside, moved))


def _in_blocks(base: nested._Matrix, labels: DataFrame, protocol: nested.Protocol, n_perm: int, moved: Sequence[str], run: Callable[..., DataFrame]) -> DataFrame:
    """What ``run`` says of all permutations, as many at a time as their labels allow."""
    groups = len(np.unique(base.part_outer))
    blocks = max(1, -(-n_perm * groups * 24 // LABEL_BYTES))
    out = None
    for k in range(blocks):
        low, high = k * n_perm // blocks, (k + 1) * n_perm // blocks
        part = run(base, labels.filter(F.col("perm").between(low, high - 1)), protocol, moved)
        out = part if out is None else out.unionByName(part)
    return out


def _one_by_one(rows: DataFrame, labels: DataFrame, protocol: nested.Protocol, n_perm: int, seed: int, moved: Sequence[str], limit: int) -> DataFrame:
    """The same rows for a table that no task holds: the distributed procedure on the moved labels of each permutation in turn."""
    place = F.create_map(*[F.lit(v) for i, c in enumerate(protocol.candidates) for v in (nested.candidate_text(c), i)])
    out = None
    for perm in range(n_perm):
        own = rows.join(F.broadcast(labels.filter(F.col("perm") == perm).drop("perm", "fold")), "grp", "left")  # one row a group
        now = {c: F.when(F.col("_in") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in moved}
        oof = nested.nested_oof(own.withColumns(now).select("row", "grp", "stratum", "y", *protocol.features), protocol, seed=seed, limit=limit)
        part = oof.select(F.lit(perm).alias("perm"), "row", "stratum", F.col("y").cast("double").alias("y"), "p_raw", "p", F.element_at(place, F.col("candidate")).alias("candidate"))
        part = checkpointed(part)
        out = part if out is None else out.unionByName(part)
    return out


def _relabelled(m: nested._Matrix, at: np.ndarray, labels: pd.DataFrame, moved: Sequence[str]) -> nested._Matrix:
    """The table under the labels and folds of one permutation; ``at`` is the group of each part."""
    y, stratum = m.part_y, m.part_stratum
    for name in moved:
        new = labels[f"_{name}"].to_numpy()[at]
        ok = m.part_flag & ~pd.isna(new)
        if name == "y":
            y = np.where(ok, pd.to_numeric(pd.Series(new), errors="coerce").to_numpy(float), y)
        else:
            stratum = np.where(ok, new.astype(object), stratum).astype(str)
    return m.relabelled(y, stratum, labels["fold"].to_numpy()[at])


def _by_permutation(base: nested._Matrix, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, pd.DataFrame]]:
    """Groups, the group of each part, and the labels of the groups per permutation."""
    pdf = labels.toPandas()  # groups times the permutations of a block
    groups, at = np.unique(base.part_outer, return_inverse=True)
    return groups, at, {int(p): part.set_index("grp").reindex(groups) for p, part in pdf.groupby("perm")}


def _run(base: nested._Matrix, labels: DataFrame, protocol: nested.Protocol, moved: Sequence[str]) -> DataFrame:
    spark = labels.sparkSession
    groups, at, table = _by_permutation(base, labels)
    shared = spark.sparkContext.broadcast((base, at, table))
    schema = "perm int, row long, stratum string, y double, p_raw double, p double, candidate int"

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, at, table = shared.value
        for block in blocks:
            for t in block.itertuples():
                now = _relabelled(m, at, table[t.perm], moved)
                test, raw, p, best = procedure(now, t.outer, protocol)
                yield pd.DataFrame({"perm": t.perm, "row": m.row[test], "stratum": now.stratum[test], "y": now.y[test], "p_raw": raw, "p": p, "candidate": best})

    def run_parts(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, at, table = shared.value
        for block in blocks:
            for perm, outers in (todo[k] for k in block["id"]):
                now = _relabelled(m, at, table[perm], moved)
                for _, parts, raw, p, best in procedures(now, outers, protocol):
                    low = 0
                    for q in np.flatnonzero(parts):  # a part has one label and one stratum
                        n = int(m.start[q + 1] - m.start[q])
                        for at_row in range(0, n, nested.SENT_ROWS):
                            many = min(nested.SENT_ROWS, n - at_row)
                            own, rows = slice(low, low + many), slice(m.start[q] + at_row, m.start[q] + at_row + many)
                            yield pd.DataFrame({"perm": perm, "row": m.row[rows], "stratum": now.part_stratum[q], "y": now.part_y[q], "p_raw": raw[own], "p": p[own], "candidate": best})
                            low += many

    if base.long_parts():
        # permutations share the fits of their outer folds; few of them are cut by outer folds until every core has two tasks
        outers = base.outers
        cuts = min(len(outers), max(1, -(-2 * spark.sparkContext.defaultParallelism // len(table))))
        todo = [(p, outers[k::cuts]) for p in sorted(table) for k in range(cuts)]
        return spark.range(0, len(todo), 1, len(todo)).mapInPandas(run_parts, schema)
    tasks = spark.createDataFrame([(p, int(g)) for p in sorted(table) for g in groups], "perm int, outer long")
    spread = tasks.repartition(spark.sparkContext.defaultParallelism * 4, "perm", "outer")
    return spread.mapInPandas(run, schema)


def null_distribution(
    df: DataFrame, protocol: nested.Protocol, n_perm: int, negatives: Column, score: str = "p", inside: Column | None = None, seed: int = 42, moved: Sequence[str] = ("y", "stratum")
) -> DataFrame:
    """Area per permutation (null where a class has no rows): ``permutation, auc``."""
    case = F.col("stratum") == strata.PTSD if "stratum" in moved else F.col("y") == 1
    label = F.when(case, True).when(negatives, False)
    rows, labels = _permuted(df, n_perm, seed, inside, moved)
    if not nested.fits_in_broadcast(rows, protocol):
        oof = _one_by_one(rows, labels, protocol, n_perm, seed, moved, nested.BROADCAST_BYTES)
    else:
        base = nested._matrix(rows, protocol, "_in")
        sides = _sides(df.sparkSession, base, label) if base.long_parts() and n_perm >= 2 * df.sparkSession.sparkContext.defaultParallelism else None
        if sides is not None:
            return _in_blocks(base, labels, protocol, n_perm, moved, partial(_areas, sides=sides, score=score))
        oof = _in_blocks(base, labels, protocol, n_perm, moved, _run)
    return ordered.auc(checkpointed(oof), ["perm"], score, label).withColumnRenamed("perm", "permutation")


def _sides(spark: SparkSession, base: nested._Matrix, label: Column) -> dict[tuple[str, float], bool | None] | None:
    """What ``label`` says of rows with each stratum and y; None if it needs more than these."""
    pairs = [(str(s), float(y)) for s in base.strata for y in np.unique(base.part_y)]
    try:
        return {(r["stratum"], r["y"]): r["label"] for r in spark.createDataFrame(pairs, "stratum string, y double").select("stratum", "y", label.alias("label")).collect()}
    except AnalysisException:
        return None


def _areas(
    base: nested._Matrix, labels: DataFrame, protocol: nested.Protocol, moved: Sequence[str], sides: dict[tuple[str, float], bool | None], score: str
) -> DataFrame:
    """``null_distribution`` of a table in long parts: a task has all predictions of its permutation and sends their area."""
    spark = labels.sparkSession
    _, at, table = _by_permutation(base, labels)
    shared = spark.sparkContext.broadcast((base, at, table))
    todo = sorted(table)

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, at, table = shared.value
        sizes = np.diff(m.start)
        for block in blocks:
            for perm in (todo[k] for k in block["id"]):
                now = _relabelled(m, at, table[perm], moved)
                found = np.empty(len(m.row))
                for _, parts, raw, p, _ in procedures(now, m.outers, protocol):
                    found[np.repeat(parts, sizes)] = raw if score == "p_raw" else p
                side = [sides[s, y] for s, y in zip(now.part_stratum.tolist(), now.part_y.tolist(), strict=True)]
                case, other = (np.repeat([v is which for v in side], sizes) for which in (True, False))
                if case.any() or other.any():
                    yield pd.DataFrame({"permutation": [perm], "auc": [area(case, other, found)]}).astype({"auc": float})

    return spark.range(0, len(todo), 1, len(todo)).mapInPandas(run, "permutation int, auc double")


def summary(null: DataFrame, observed: float) -> DataFrame:
    """Size, mean and 95 % quantile of the null distribution and the one-sided p-value."""
    null = checkpointed(null)
    agg = null.agg(F.count("auc").alias("n_permutations"), F.avg("auc").alias("null_mean"), resample.permutation_p(F.lit(observed), F.col("auc")).alias("p_value"))
    return agg.crossJoin(ordered.quantiles(null, [], "auc", {"null_q95": 0.95})).withColumn("observed_auc", F.lit(observed))
