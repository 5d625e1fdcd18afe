"""Exact join of documents on word-shingle Jaccard similarity with signature trees.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are copies and go on as one.
Two similar sets share one of their rarest shingles (prefix filter under any common order), where "rare" comes from a
count sketch of fixed size over all documents: it orders shingles, it never decides a link. Only shingles that several
sets have in their prefix remain, one for each distinct group of owners; positions and sizes drop owners that cannot
reach the similarity. What stays is grouped into candidate components. A component, cut into chunks of bounded shingle
count, becomes signature trees: leaves are bitmaps of single sets ordered by size, inner nodes hold the OR of their
bitmaps, the size range and the largest excess of elements over bits. Dual traversal drops a pair of nodes when the
largest possible overlap cannot reach the similarity for their smallest sizes; leaf pairs that are not yet connected are
verified on the sets. Tasks report a spanning forest, never all pairs.

Defined cases: null or empty texts and texts without a word have an empty set and link with nothing; with fewer words than
a shingle the whole sequence is one shingle; equal texts link; rows with the same ``doc_id`` are one node; a null
``doc_id`` links with nothing and has a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import shuffle_parts, small_batches, stored, whole_text
from sigloom.operators.fingerprint import connected_components

WORDS = 5
PERCENT = 80
SKETCH_CELLS = 1 << 18
SKETCH_BLOCK = 1 << 12
SMALL_KEY = 256
CHUNK_SHINGLES = 1 << 19
MIN_BITS_LOG, MAX_BITS_LOG = 8, 16
FANOUT = 16
PAIRS_AT_ONCE = 1 << 15
BUFFER_BYTES = 1 << 20
#: candidate ids that may be broadcast (16 bytes each); more of them are joined by a shuffle
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return lower, blank


class Shingler:
    """Sets of shingle hashes of whole texts, computed on byte buffers of a bounded size."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.size = words, 0
        self.lower, self.blank = _byte_tables()

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BUFFER_BYTES)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.size, _ODD)]))
                self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.size, _INVERSE)]))

    def _buffer(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = self.lower[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
        self._powers(len(raw))
        gap = self.blank[raw]
        begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])
            word = _mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            edges = np.cumsum([1, *[len(t) + 1 for t in texts]])
            bound = np.searchsorted(begin, edges)
            n = len(word)
            whole = word[: max(0, n - self.words + 1)].copy()
            for k in range(1, min(self.words, n)):
                whole = _mixed(whole * _ODD + word[k : k + len(whole)])
            out = []
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                if b - a >= self.words:
                    out.append(np.unique(whole[a : b - self.words + 1]))
                elif b > a:
                    h = word[a : a + 1]
                    for k in range(a + 1, b):
                        h = _mixed(h * _ODD + word[k : k + 1])
                    out.append(h.copy())
                else:
                    out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        waiting, held = [], 0
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            if waiting and held + len(raw) > BUFFER_BYTES:
                yield from self._buffer(waiting)
                waiting, held = [], 0
            waiting.append(raw)
            held += len(raw) + 1
        if waiting:
            yield from self._buffer(waiting)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Elements of which two similar sets must share one, under a common order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def shingle_sketch(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Counts of shingles by hash cell over all documents: a table of fixed size, summed in two levels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, shingler = np.zeros(SKETCH_CELLS, np.int64), Shingler(words)
        for batch in batches:
            found = list(shingler.sets(batch.column("text").to_pylist()))
            if found:
                total += np.bincount(_cells(np.concatenate(found)), minlength=SKETCH_CELLS)
        blocks = total.reshape(-1, SKETCH_BLOCK)
        lane = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "lane": pa.array([lane] * len(blocks), pa.int32()), "counts": [b.tobytes() for b in blocks]})

    def add(keys: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for batch in group:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([keys[0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    parts = texts.mapInArrow(count, "block int, lane int, counts binary")
    parts = parts.groupBy("block", "lane").applyInArrow(add, "block int, counts binary")
    rows = parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect()  # a fixed number of rows
    out = np.zeros((SKETCH_CELLS // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def set_id(s: np.ndarray) -> int:
    """64-bit digest of a sorted set; documents with equal sets share it."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(s: np.ndarray) -> bytes:
    """Bitmap of about two bits an element; a wider one folds to a narrower by OR of its halves."""
    bits = 1 << min(MAX_BITS_LOG, max(MIN_BITS_LOG, int(2 * len(s)).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    bit = ((s >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return out.tobytes()


def document_sets(docs: DataFrame, sketch: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, set size, set digest, signature, and the rarest elements of the set in order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shingler = shared.value, Shingler(words)
        for batch in batches:
            sizes, sids, maps, keys, ranks = [], [], [], [], []
            for s in shingler.sets(batch.column("text").to_pylist()):
                rank = order[_cells(s)]
                first = np.lexsort((s.view(np.int64), rank))[: prefix_length(len(s), percent)]  # the order of the table's keys
                sizes.append(len(s))
                sids.append(set_id(s))
                maps.append(signature(s))
                keys.append(s[first].view(np.int64))
                ranks.append(rank[first])
            ends = np.cumsum([0, *[len(k) for k in keys]]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((keys, np.int64), (ranks, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(maps, pa.binary()), *lists],
                names=["doc_id", "n_shingles", "sid", "signature", "keys", "ranks"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid long, signature binary, keys array<long>, ranks array<int>")


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bytes; each is that wide or twice as wide."""
    rows = [np.frombuffer(m, np.uint64) for m in maps]
    return np.stack([r if 8 * len(r) == width else r[: len(r) // 2] | r[len(r) // 2 :] for r in rows])


def likely_pairs(n: np.ndarray, pos: np.ndarray, maps: list[bytes], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners of one key that positions, sizes and bitmaps cannot rule out; the key is their first common element."""
    left = n - pos - 1
    most = 1 + np.minimum(left[:, None], left[None, :])
    i, j = np.nonzero(np.triu((100 + percent) * most >= percent * (n[:, None] + n[None, :]), 1))
    width = np.array([len(m) for m in maps], np.int64)
    narrow, ok = np.minimum(width[i], width[j]), np.zeros(len(i), bool)
    for w in np.unique(narrow).tolist():
        at = np.flatnonzero((narrow == w) & (np.maximum(width[i], width[j]) <= 2 * w))
        near = np.flatnonzero((width == w) | (width == 2 * w))
        place = np.zeros(len(n), np.int64)
        place[near] = np.arange(len(near))
        bits = _folded([maps[k] for k in near.tolist()], w)
        excess = n[near] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for s in range(0, len(at), PAIRS_AT_ONCE):
            some = at[s : s + PAIRS_AT_ONCE]
            x, y = place[i[some]], place[j[some]]
            common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(excess[x], excess[y])
            ok[some] = (100 + percent) * common >= percent * (n[i[some]] + n[j[some]])
    return i[ok], j[ok]


def _candidate_links(base: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between set digests that hold every similar pair within a component."""
    rows = base.select("sid", F.col("n_shingles").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))
    # exact copies count once: the digests below tell sets of owners apart only if every owner enters one time
    sole = base.select("sid", "keys", "ranks").dropDuplicates(["sid"]).select("sid", F.explode(F.arrays_zip("keys", "ranks")).alias("_e"))
    sole = sole.select(F.col("_e.keys").alias("key"), F.col("_e.ranks").alias("rank"), "sid")
    owners = sole.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.bit_xor("sid").alias("_x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("_y"), F.min("sid").alias("lowest"), F.max("sid").alias("_high"), F.min("rank").alias("rank"))
    owners = owners.filter("lowest < _high")
    # one key for each group of owners: the first in the common order, so positions stay valid for the first common element
    kept = owners.groupBy("_c", "_x", "_y", "lowest", "_high").agg(F.min(F.struct("rank", "key")).alias("_k")).select(F.col("_k.key").alias("key"), "lowest")
    members = stored(rows.join(kept, "key").distinct(), "members")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n_owners"))
    members = members.join(counts, "key")
    large = members.filter(F.col("n_owners") > SMALL_KEY).select(F.col("sid").alias("a"), F.col("lowest").alias("b"))
    maps = base.select("sid", "signature").join(members.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    small = members.filter(F.col("n_owners") <= SMALL_KEY).join(maps, "sid").select("key", "sid", "n", "pos", "signature")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: list[tuple]) -> list[tuple[int, int]]:
            n, pos = (np.array([r[c] for r in part], np.int64) for c in (2, 3))
            i, j = likely_pairs(n, pos, [r[4] for r in part], percent)
            return [(part[x][1], part[y][1]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]

        def batch_of(found: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        held: list[tuple] = []
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "sid", "n", "pos", "signature")], strict=True):
                if held and held[0][0] != row[0]:
                    found.update(linked(held))
                    held = []
                held.append(row)
            if len(found) > 50_000:
                yield batch_of(found)
                found = set()
        found.update(linked(held))
        yield batch_of(found)

    ordered = small.repartition(shuffle_parts(base.sparkSession), "key").sortWithinPartitions("key")
    return large.filter("a <> b").unionByName(ordered.mapInArrow(pairs, "a long, b long")).distinct()


class SignatureTree:
    """Levels of nodes over sets ordered by size: OR of the bitmaps, size range, largest excess of elements over bits."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(sizes, kind="stable")
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order.tolist()):
            bit = (sets[i] >> np.uint64(40)).astype(np.int64) % bits
            np.bitwise_or.at(maps[row], bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        sizes = sizes[self.order]
        excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, more = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]


def _possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair of nodes may hold a similar pair: size ranges, then the largest possible overlap."""
    ok = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    most = np.minimum(common, np.minimum(a[2][i], b[2][j]))
    ok[at] = (100 + percent) * most >= percent * (a[1][i] + b[1][j])
    return ok


def _leaf_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal from the roots; yields surviving leaf pairs (positions in the two trees)."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        ok = _possible(a.level(k), b.level(k), i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        sub = np.arange(FANOUT)
        # a tree that is lower than the other keeps its root
        di = sub if k < len(a.levels) else sub[:1]
        dj = sub if k < len(b.levels) else sub[:1]
        fi, fj = (FANOUT if k < len(a.levels) else 1), (FANOUT if k < len(b.levels) else 1)
        step = max(1, PAIRS_AT_ONCE // (len(di) * len(dj)))
        for s in range(0, len(i), step):
            x = (i[s : s + step, None, None] * fi + di[None, :, None] + 0 * dj).reshape(-1)
            y = (j[s : s + step, None, None] * fj + 0 * di[None, :, None] + dj).reshape(-1)
            keep = (x < len(a.level(k - 1)[1])) & (y < len(b.level(k - 1)[1]))
            if same:
                keep &= x < y if k == 1 else x <= y
            stack.append((k - 1, x[keep], y[keep]))


def similar_forest(ids: list[int], sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the similar pairs; with ``side`` only pairs from different sides are looked for."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest: list[tuple[int, int]] = []

    def link(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a == b:
            return
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            parent[max(a, b)] = min(a, b)
            if ids[x] != ids[y]:
                forest.append((ids[x], ids[y]))

    mean = sum(map(len, sets)) // max(1, len(sets))
    bits = 1 << min(13, max(8, int(2 * mean).bit_length()))
    groups = [list(range(len(sets)))] if side is None else [np.flatnonzero(side == s).tolist() for s in (0, 1)]
    if not all(groups):
        return forest
    trees = [SignatureTree([sets[i] for i in g], bits) for g in groups]
    place = [np.array(g)[t.order] for g, t in zip(groups, trees, strict=True)]
    for i, j in _leaf_pairs(trees[0], trees[-1], percent):
        x, y = place[0][i], place[-1][j]
        first = np.unique(y, return_index=True)[1]
        for k in first.tolist():
            link(int(x[k]), int(y[k]))
        root = np.array([find(k) for k in range(len(sets))])
        for k in np.flatnonzero(root[x] != root[y]).tolist():
            link(int(x[k]), int(y[k]))
    return forest


def _verified_links(candidates: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning forests of all candidate components. ``candidates``: doc_id (one a set), root, n_shingles."""
    sizes = candidates.groupBy("root").agg((F.floor((F.sum("n_shingles") - 1) / CHUNK_SHINGLES) + 1).cast("int").alias("n_chunks"))
    dealt = candidates.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int"))
    dealt = stored(dealt.select("doc_id", "root", "n_chunks", "chunk").distinct(), "chunks")
    few = dealt.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(dealt) if few else dealt, "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    work = found.withColumn("_o", other).select("text", "chunk", "root", F.least("chunk", "_o").alias("i"), F.greatest("chunk", "_o").alias("j"))

    def run(keys: tuple, group: pa.Table) -> pa.Table:
        i, j = keys[1].as_py(), keys[2].as_py()
        sets = list(Shingler(words).sets(group.column("text").to_pylist()))
        side = None if i == j else (group.column("chunk").to_numpy() == j).astype(int)
        forest = similar_forest([set_id(s) for s in sets], sets, side, percent)
        return pa.table({"a": pa.array([a for a, _ in forest], pa.int64()), "b": pa.array([b for _, b in forest], pa.int64())})

    return work.groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked ``doc_id``)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", whole_text().alias("text"))
    base = stored(document_sets(texts, shingle_sketch(texts, words), words, percent), "sets")
    known = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    ends = lambda links: links.select(F.col("a").alias("sid")).union(links.select("b")).distinct()

    likely = stored(_candidate_links(known, percent), "likely")
    candidates = connected_components(ends(likely), likely, "sid", "root").join(first, "sid").select("doc_id", "root", "n_shingles")
    # rows that share an id are one document
    shared = known.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("_h")).filter("a <> _h").select("doc_id", "a")
    shared = known.select("doc_id", F.col("sid").alias("b")).join(shared, "doc_id").filter("a <> b").select("a", "b")
    links = stored(_verified_links(candidates, texts, words, percent).unionByName(shared), "links")
    roots = connected_components(ends(links), links, "sid", "root").join(first.select("sid", "doc_id"), "sid")
    linked = roots.join(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("sid", "component_id")
    classes = first.select("sid", "doc_id").join(linked, "sid", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return base.select("doc_id", "n_shingles", "sid").join(classes, "sid", "left").select("doc_id", "n_shingles", alone.alias("component_id"))
