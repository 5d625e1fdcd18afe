"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are the runs of digits, letters a to z (A to Z count as these) and characters from U+0080 on. A benchmark item gives its
windows of ten words, a shorter one its whole sequence. Spark makes the distinct (window, item) pairs; they are dealt by hash into
blocks of a bounded size, so that a benchmark of any size is searched block by block. A block is broadcast as a hash set: a
vocabulary, and per window length a bitmap over hash bits and the sorted 64-bit hashes with the word ids behind them. A task turns
its texts into word ids, rolls the hash over all windows of a batch, and verifies what the set contains word by word. Nothing of the
documents is shuffled. What was hit is kept as runs of words; ``decontaminate`` removes these spans or whole documents.

Defined cases: a null text has no words, as has one without word characters; an item without words has no window; a null
``item_id`` marks words but is never listed or counted; repeated items and rows of documents count as they are, each row of
documents gives one row; no items or no documents give no hits or no rows; a text of any length is searched whole; other
columns pass through ``decontaminate`` unchanged and are ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import small_batches, stored, whole_text

WINDOW = 10
BLOCK_PAIRS = 300_000
BITMAP_BITS = 22
PIECE_BYTES = 4 << 20
STEP = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# word bytes as lower case, all others as blanks
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<first:int,last:int>>"


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``window`` (words joined by blanks) and ``item`` (its id as text)."""
    words = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (size - 1)))
    window = F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, size), " ")))
    return rows.select("item", window.alias("window")).distinct()


class WindowSet:
    """Hash set of the windows of one block, with the items of each."""

    def __init__(self, pairs: list[tuple[str, str | None]]) -> None:
        items: dict[str, list[str]] = {}
        for window, item in pairs:
            items.setdefault(window, []).extend([] if item is None else [item])
        split = {w: w.encode().split(b" ") for w in items}
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        by_length: dict[int, list[str]] = {}
        for window, ws in split.items():
            by_length.setdefault(len(ws), []).append(window)
        self.tables = []
        for k, windows in sorted(by_length.items()):
            rows = np.array([[self.ids[w] for w in split[window]] for window in windows], np.uint64)
            hashes = rolled(rows.T, len(rows))
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[_slot(hashes)] = True
            hashes = hashes[order]
            equal = np.unique(hashes, return_counts=True)[1].max()
            self.tables.append((k, np.packbits(bitmap), hashes, rows[order], [tuple(sorted(items[windows[i]])) for i in order], int(equal)))

    def word_ids(self, text: bytes) -> np.ndarray:
        """Ids of the words of a text, 0 for words that are in no window."""
        flat, get, at, parts = text.translate(NORMAL), self.ids.get, 0, []
        while at < len(flat):
            end = flat.find(b" ", at + PIECE_BYTES)
            end = len(flat) if end < 0 else end
            words = flat[at:end].split()
            parts.append(np.fromiter(map(get, words, repeat(0)), np.uint64, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[str, ...]]]]:
        """Per length: starts and rows of the verified windows. A 0 in ``ids`` is in no window, so 0 may separate texts."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, bitmap, hashes, rows, items, equal in self.tables:
            for low in range(0, len(ids) - k + 1, STEP):
                n = min(STEP, len(ids) - k + 1 - low)
                at = low + np.flatnonzero(known[low + k : low + k + n] - known[low : low + n] == k)
                if not len(at):
                    continue
                h = rolled([ids[at + j] for j in range(k)], len(at))
                slot = _slot(h)
                maybe = (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                at, h = at[maybe], h[maybe]
                first = np.searchsorted(hashes, h)
                for turn in range(equal):
                    row = np.minimum(first + turn, len(hashes) - 1)
                    same = hashes[row] == h
                    for j in range(k):
                        same &= rows[row, j] == ids[at + j]
                    if same.any():
                        yield k, at[same], row[same], items


def rolled(columns: list[np.ndarray] | np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for c in columns:
        h = h * FACTOR + c
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * FACTOR >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def search(texts: list[bytes], windows: WindowSet, spans: list | None = None, items: list | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Per text: number of words, runs of hit words and items, together with those found before in other blocks."""
    parts, zero = [], np.zeros(1, np.uint64)
    for t in texts:
        parts += [windows.word_ids(t), zero]
    size = np.array([len(p) for p in parts[::2]], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    ids = np.concatenate(parts) if parts else zero
    mark = np.zeros(len(ids) + 1, np.int32)
    found: dict[int, set[str]] = {d: set(x) for d, x in enumerate(items or []) if x}
    for d, before in enumerate(spans or []):
        for s in before or []:
            mark[begin[d] + s["first"]] += 1
            mark[begin[d] + s["last"]] -= 1
    for k, at, row, names in windows.find(ids):
        np.add.at(mark, at, 1)
        np.add.at(mark, at + k, -1)
        owner = np.searchsorted(begin, at, side="right") - 1
        for d, r in np.unique(np.stack([owner, row], axis=1), axis=0).tolist():
            found.setdefault(d, set()).update(names[r])
    hit = np.diff((np.cumsum(mark) > 0).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip((np.searchsorted(begin, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
        runs[d].append((a - int(begin[d]), b - int(begin[d])))
    return size.tolist(), runs, [sorted(found.get(d, ())) for d in range(len(texts))]


def _blocks(benchmark: DataFrame, size: int, most: int) -> tuple[list[WindowSet], int]:
    pairs = stored(benchmark_windows(benchmark, size), "windows")
    n = max(1, -(-pairs.count() // most))
    for k in range(n):
        # about ``most`` pairs reach the driver at a time
        block = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == k) if n > 1 else pairs
        yield WindowSet([(r["window"], r["item"]) for r in block.collect()]), n


def scan(documents: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Columns ``keep`` as ``_c0, _c1, ..``, the text as ``_text``, and ``n_words``, ``spans`` (runs of hit words), ``items``."""
    spark = documents.sparkSession
    small_batches(spark)
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)]
    rows = documents.select(*carried, F.col("text").alias("_text"))
    types = ", ".join(f"_c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = f"{types + ', ' if types else ''}_text string, n_words long, spans {SPANS}, items array<string>"
    for k, (windows, n) in enumerate(_blocks(benchmark, size, block_pairs)):
        shared = spark.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("_text")
                texts = [(t or "").encode() for t in column.to_pylist()]
                before = (batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if "spans" in batch.schema.names else (None, None)
                n_words, spans, items = search(texts, shared.value, *before)
                span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                kept = [(name, batch.column(name)) for name in batch.schema.names if name not in ("n_words", "spans", "items")]
                new = [("n_words", pa.array(n_words, pa.int64())), ("spans", pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], span)), ("items", pa.array(items, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([c for _, c in kept + new], names=[c for c, _ in kept + new])

        rows = rows.mapInArrow(run, out)
        rows = stored(rows, "block") if n > 1 else rows
    return rows


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row of documents: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the hit ``spans`` in words."""
    rows = scan(documents, benchmark, ["doc_id"], size, block_pairs)
    return rows.select(
        F.col("_c0").alias("doc_id"), "n_words", hit_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each run."""
    at, out, word = 0, [], 0
    runs = iter(spans)
    run = next(runs, None)
    for m in ANY_CASE.finditer(text):
        if run is None:
            break
        if word == run[0]:
            out.append(text[at : m.start()])
        word += 1
        if word == run[1]:
            at, run = m.end(), next(runs, None)
    return "".join([*out, text[at:]])


def decontaminate(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", most_share: float = 0.0, size: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Documents without benchmark passages: ``documents`` drops rows of which more than ``most_share`` of the words are hit, ``spans`` removes hit words."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    rows = scan(documents, benchmark, documents.columns, size, block_pairs)
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate(documents.columns)]
    if mode == "documents":
        return rows.filter(hit_words("spans") <= most_share * F.col("n_words")).select(names)
    place = f"_c{documents.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = [without_spans(t, [(s["first"], s["last"]) for s in x]) if x else t for t, x in zip(batch.column(place).to_pylist(), spans, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names if n.startswith("_c")} | {place: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [f"_c{i}" for i in range(len(documents.columns))]
    return rows.select(*fields, "spans").mapInArrow(run, rows.select(*fields).schema).select(names)
