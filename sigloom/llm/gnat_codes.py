"""Vector code compression: one codebook a part of the vectors, searched with a geometric near-neighbour access tree (GNAT).

Components become integers. A codebook is trained by rounds of assignment and floored means; a task assigns its vectors and returns
one row of sums a (part, entry), so a round shuffles a table of fixed size a task. Codebooks are the only data on the driver.

The entries of a codebook form a GNAT: a node has split points, each with a child that holds the entries nearest to it, and for
every (split point, child) the range of distances from the split point to the child's entries. All vectors of a batch descend
together: distances to the split points update the best entry, and by the triangle inequality a child is left to the vectors for
which some split point's range lies strictly outside the ball of their best distance. Ranges are widened and balls enlarged by more
than the rounding error, so a tie is never ruled out; the best entry itself is decided on integer squared distances, ties to
the lower index.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, as are those with a component from
2^16 on in size (their squared distances would not fit) and those whose length differs from that of the first of all, or is no
multiple of the number of parts; the first vectors of a codebook go by id, then by the vector, null ids last; with fewer vectors
than entries a codebook is shorter; repeated rows count each; null labels are one label; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SPLITS = 6
LEAF = 8
LARGEST = 1 << 16
LABELS = 50_000
SALTS = 64
# beyond all rounding of roots and sums of distances in double precision
SLACK = 1e-9


class Gnat:
    """GNAT over integer points; a node is (split points, lows, highs, children), a leaf an array of points."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.root = self._node(np.arange(len(points)))

    def _apart(self, members: np.ndarray, split: int) -> np.ndarray:
        d = self.points[members] - self.points[split]
        return np.sqrt((d * d).sum(axis=1).astype(float))

    def _node(self, members: np.ndarray) -> tuple | np.ndarray:
        if len(members) <= LEAF:
            return members
        # split points far from each other, starting with the lowest index
        splits, apart = [int(members[0])], [self._apart(members, int(members[0]))]
        while len(splits) < SPLITS:
            nearest = np.min(apart, axis=0)
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            splits.append(int(members[far]))
            apart.append(self._apart(members, splits[-1]))
        if len(splits) == 1:
            return members
        distance = np.array(apart)
        owner, inner = distance.argmin(axis=0), ~np.isin(members, splits)
        low, high, children = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf), []
        for c in range(len(splits)):
            mine = inner & (owner == c)
            children.append(self._node(members[mine]) if mine.any() else None)
            if mine.any():
                low[:, c], high[:, c] = distance[:, mine].min(axis=1), distance[:, mine].max(axis=1)
        return np.array(splits), low * (1 - SLACK) - SLACK, high * (1 + SLACK) + SLACK, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest point to each query, and how many distances were computed."""
        best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), -1)
        self.computed = 0
        if len(self.points):
            self._descend(self.root, queries, np.arange(len(queries)), best, index)
        return index, best, self.computed

    def _measure(self, candidates: np.ndarray, queries: np.ndarray, active: np.ndarray, best: np.ndarray, index: np.ndarray) -> list[np.ndarray]:
        out, mine = [], queries[active]
        for c in candidates.tolist():
            diff = mine - self.points[c]
            d = np.einsum("ij,ij->i", diff, diff)
            better = (d < best[active]) | ((d == best[active]) & (c < index[active]))
            best[active[better]], index[active[better]] = d[better], c
            out.append(d)
        self.computed += len(candidates) * len(active)
        return out

    def _descend(self, node: tuple | np.ndarray, queries: np.ndarray, active: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not isinstance(node, tuple):
            self._measure(node, queries, active, best, index)
            return
        splits, low, high, children = node
        distance = np.sqrt(np.array(self._measure(splits, queries, active, best, index), float))
        nearest = distance.argmin(axis=0)
        # children in the order of how many queries begin there, so that balls are small before the others are tried
        for c in np.argsort(-np.bincount(nearest, minlength=len(children)), kind="stable").tolist():
            if children[c] is None:
                continue
            ball = np.sqrt(best[active].astype(float)) * (1 + SLACK) + SLACK
            out = ((distance - ball > high[:, c, None]) | (distance + ball < low[:, c, None])).any(axis=0)
            if not out.all():
                self._descend(children[c], queries, active[~out], best, index)


def valid(v: Column, parts: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~F.coalesce(bad, F.lit(False))


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(rows, parts, width) of integers."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, -1)


def assigned(vectors: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part."""
    found = [t.nearest(vectors[:, p]) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Per part, entry and position: count and sum of the assigned parts."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in shared.value]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch, parts)
            index, _ = assigned(vectors, trees)
            for p in range(parts):
                np.add.at(total[p], index[:, p], vectors[:, p])
                count[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
        )

    local = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return local.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) from integer vectors ``v`` of one length."""
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(rows, books).collect():
            books[r["part"], r["entry"], r["place"]] = r["x"] // r["n"]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: ``vec_id, code, error, label_error, codebooks_sha256``. Columns read: ``vec_id, embedding, label``."""
    if entries > 256:
        raise ValueError("an entry is written as two hex digits")
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "label", F.col("embedding").alias("v")).filter(valid(F.col("v"), parts))
    whole = good.select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    length = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("k")).head()
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if length is None:
        return spark.createDataFrame([], result)
    rows = stored(whole.filter(F.size("v") == length["k"]), "integers")
    books = trained(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in shared.value]
        for batch in batches:
            index, distance = assigned(_matrix(batch, parts), trees)
            codes = [bytes(r).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stored(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Few labels are sent to every task; many are joined with the rows of each label spread by a salt."""
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "totals")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= LABELS:
        return coded.join(F.broadcast(totals), same, "left")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    spread = totals.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_to")), "left")
