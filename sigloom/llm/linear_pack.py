"""Packing of documents into sequences by linear grouping.

Lengths are integers up to the capacity, so the histogram of lengths is a bounded table whatever the corpus holds. The
plan is made on histograms only:

1. lengths above a part of the capacity are ordered downwards and cut into groups of equal cardinality; a group counts
   as its largest length (rounding up);
2. few sizes remain; the best mix of configurations (multisets of sizes that fit one sequence) comes from the
   configuration linear program, solved by column generation with a knapsack, rounded down, and first-fit for the rest;
3. the actual documents replace the rounded sizes: position in the order -> group -> slot -> sequence is arithmetic;
4. what the actual lengths leave free takes the small documents by best fit, again by classes: the plan is a list of
   "items i..j of this length go to sequences p..q of this free space".

Rows get their ranks from windows over (length, salt), so one frequent length is spread over many tasks. Only
histograms (at most ``capacity`` rows) reach the driver.

Defined cases: a null text is the empty text (just the end id); equal texts and repeated rows are packed as separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import ranked_within, salts_for, small_batches, stored, whole_text
from sigloom.llm.token_cache import chunk_encoder

CAPACITY = 4096
GROUPS = 16
#: lengths above capacity / part are large; the part with the fewest planned sequences is taken
SMALL_PARTS = (3, 4, 8)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Span = tuple[int, int, int, int]  # first position, end, first sequence, items a sequence


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, glued: bool = False) -> DataFrame:
    """Ids of every document with the end id, cut only where longer than ``capacity``."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer, glued)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, PIECES)


def _best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over the few sizes."""
    best = np.zeros(capacity + 1)
    for s, v in zip(sizes, values, strict=True):
        if v > 0:
            for _ in range(capacity // s):
                best[s:] = np.maximum(best[s:], best[:-s] + v)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while True:
        for g, (s, v) in enumerate(zip(sizes, values, strict=True)):
            if v > 0 and s <= room and best[room] <= best[room - s] + v + 1e-12 and best[room] > 0:
                counts[g] += 1
                room -= s
                break
        else:
            return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations with their numbers of sequences: the linear program rounded down, first fit for the remainder."""
    k, need = len(sizes), np.array(demand, float)
    if not k:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(steps):
        value, column = _best_configuration(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-9:
            break
        direction, level = np.linalg.solve(basis, column.astype(float)), np.linalg.solve(basis, need)
        ratio = np.where(direction > 1e-10, level / np.where(direction > 1e-10, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(np.int64)
    chosen, left = [], np.array(demand, np.int64)
    for j in range(k):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        times = int(min(max(level[j], 0), (left[used] // column[used]).min()))
        if times:
            chosen.append((column, times))
            left -= times * column
    while left.any():
        column, room = np.zeros(k, np.int64), capacity
        for g in sorted(range(k), key=lambda g: -sizes[g]):
            take = min(int(left[g]), room // sizes[g])
            column[g] += take
            room -= take * sizes[g]
        used = column > 0
        times = int((left[used] // column[used]).min())
        chosen.append((column, times))
        left -= times * column
    return chosen


def plan_large(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[Span], int, list[tuple[int, int, int]]]:
    """Spans over the positions of all large documents, longest first; the sequences used; their free space as planned."""
    lengths = sorted(counts, reverse=True)
    total = sum(counts.values())
    sizes, demand, begin = [], [], []
    ends = np.cumsum([counts[n] for n in lengths])
    # few different lengths need no rounding: each is a group of its own
    cuts = [0, *ends.tolist()] if len(lengths) <= groups else [total * g // groups for g in range(groups + 1)]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        if first == end:
            continue
        size = lengths[int(np.searchsorted(ends, first, "right"))]
        if sizes and sizes[-1] == size:
            demand[-1] += end - first
        else:
            sizes.append(size)
            demand.append(end - first)
            begin.append(first)
    spans, used, taken, free = [], 0, [0] * len(sizes), []
    for column, times in configurations(sizes, demand, capacity):
        for g in np.flatnonzero(column):
            first = begin[g] + taken[g]
            spans.append((first, first + int(column[g]) * times, used, int(column[g])))
            taken[g] += int(column[g]) * times
        free.append((capacity - int(column @ np.array(sizes)), used, times))
        used += times
    return sorted(spans), used, free


def plan_small(small: dict[int, int], free: list[tuple[int, int, int]], capacity: int, opened: int) -> tuple[dict[int, list[Span]], int]:
    """Best fit by classes: for each small length, which of its items go to which sequences.

    ``free`` lists (free space, first sequence, count); ``opened`` sequences exist. Returns spans with one item a
    sequence by length, and the number of sequences at the end.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    for space, first, n in free:
        room.setdefault(space, []).append((first, n))
    order = sorted(room)
    plan: dict[int, list[Span]] = {}

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                room[space] = []
                insort(order, space)
            room[space].append((first, n))

    for length in sorted(small, reverse=True):
        done, n, spans = 0, small[length], plan.setdefault(length, [])
        while done < n:
            i = bisect_left(order, length)
            if i < len(order):
                space = order[i]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space], order[i]
            else:
                space, each = capacity, capacity // length
                first, count = opened, -(-(n - done) // each)
                opened += count
            each = space // length
            full = min(count, (n - done) // each)
            if full:
                for _ in range(each):
                    spans.append((done, done + full, first, 1))
                    done += full
                put(space - each * length, first, full)
            if full < count and done < n and n - done < each:
                rest = n - done
                for _ in range(rest):
                    spans.append((done, done + 1, first + full, 1))
                    done += 1
                put(space - rest * length, first + full, 1)
                full += 1
            put(space, first + full, count - full)
    return plan, opened


def small_limit(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> int:
    """Length up to which documents are small: the choice that plans the fewest sequences, on rounded lengths."""
    found = []
    for part in SMALL_PARTS:
        limit = capacity // part
        _, used, free = plan_large({n: c for n, c in counts.items() if n > limit}, capacity, groups)
        found.append((plan_small({n: c for n, c in counts.items() if n <= limit}, [f for f in free if f[0]], capacity, used)[1], part, limit))
    return min(found)[2]


def _follow(df: DataFrame, position: str, spans: list[Span], out: str, by: str | None = None, plan: dict[int, list[Span]] | None = None) -> DataFrame:
    """Adds ``out``: the sequence of a position, by binary search in the spans (of the row's ``by`` where given)."""
    tables = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in (plan if plan is not None else {0: spans}).items()}
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {out} long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(position).to_numpy(zero_copy_only=False)
            key = np.zeros(len(at), np.int64) if by is None else batch.column(by).to_numpy(zero_copy_only=False)
            found = np.zeros(len(at), np.int64)
            for k in np.unique(key):
                rows = key == k
                table = tables[int(k)]
                i = np.searchsorted(table[:, 0], at[rows], "right") - 1
                found[rows] = table[i, 2] + (at[rows] - table[i, 0]) // table[i, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, out])

    return df.mapInArrow(place, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces (columns ``doc_id, piece, start, length``; 1 <= length <= capacity)."""
    order = ["doc_id", "piece", "start"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    small_to = small_limit(counts, capacity, groups)
    salts = salts_for(max(counts.values(), default=0))
    ranked = ranked_within(pieces, "length", order, salts)
    large = {n: c for n, c in counts.items() if n > small_to}
    small = {n: c for n, c in counts.items() if n <= small_to}
    spans, used, _ = plan_large(large, capacity, groups)

    starts, at = {}, 0
    for n in sorted(large, reverse=True):
        starts[n], at = at, at + large[n]
    first = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("length")) if starts else F.lit(0)
    big = ranked.filter(F.col("length") > small_to).withColumn("_position", F.col("_rank") + first)
    big = stored(_follow(big.drop("_rank"), "_position", spans, "_bin").drop("_position"), "large")

    bins = big.groupBy("_bin").agg((F.lit(capacity) - F.sum("length")).alias("_free"))
    bins = ranked_within(bins, "_free", ["_bin"], salts)
    free = {r["_free"]: r["n"] for r in bins.groupBy("_free").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    classes, base, at = [], {}, 0
    for space in sorted(free):
        classes.append((space, at, free[space]))
        base[space], at = at, at + free[space]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("_free")) if base else F.lit(0)
    bins = bins.select("_bin", (F.col("_rank") + offset).cast("long").alias("sequence_id"))
    plan, _ = plan_small(small, [c for c in classes if c[0]], capacity, used)

    cols = [*pieces.columns, "sequence_id"]
    placed = big.join(bins, "_bin").select(*cols)
    if small:
        rest = _follow(ranked.filter(F.col("length") <= small_to), "_rank", [], "sequence_id", "length", plan)
        placed = placed.unionByName(rest.select(*cols))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order)  # at most `capacity` rows a sequence
    return placed.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
