"""Exact threshold join of embeddings within a label by dual traversal of cover trees.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2 c)`` apart, so the join is a distance join. A vector is turned by a fixed rotation
(directions of most variance of a bounded sample; any rotation gives the same result) and described by its first coordinates and the
length of the rest. These short descriptions are unit vectors too and never further apart than the vectors, so a tree over them
may rule out pairs exactly, also where the vectors themselves are all about equally far from each other.

A label's distinct vectors form one tree. Its upper levels are Spark tables: a cell above the chunk size is divided among pivots drawn
from its members, until all fit. Each chunk then gets its own levels once, in one task, and is stored with them. A node's
children are a net of its members: centres are taken farthest first until all lie within half of the node's radius or there are
``FAN``; nodes of few members are leaves. Every node has the covering radius of its members, in descriptions and in full vectors.
The dual traversal runs over tables of node pairs above and over arrays inside a pair of chunks: node pairs whose centres are
further apart than both radii and the threshold allow go, node pairs whose members all lie within the threshold are taken whole, and
what remains at the leaves is compared by descriptions first and by cosines in double precision last. A task reports link counts and
a spanning root for each linked vector, never pairs.

Defined cases: null, empty or zero vectors and vectors with null or non-finite components link with nothing, as do rows
with a null label; vectors of different length do not link; equal vectors of a label are linked copies and counted as such;
repeated rows are one vector; a null ``vec_id`` has a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import stored
from sigloom.operators.fingerprint import connected_components

COSINE = 0.93
CHUNK = 2048
SHORT = 16
FAN = 16
LEAF = 64
PIVOTS = 64
FEW_CELLS = 10_000
SAMPLE, SAMPLE_NUMBERS = 4096, 1 << 22
SLACK = 1e-6
EDGES = 1 << 20
NODE = ("label", "dim", "level", "cell")


def directions(sample: np.ndarray) -> np.ndarray:
    """Columns: the orthogonal directions in which unit vectors vary most."""
    _, turned = np.linalg.eigh(sample.T @ sample)
    return turned[:, ::-1][:, :SHORT]


def any_directions(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(SHORT, dim))))[0]


def described(unit: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """First rotated coordinates and the length of the rest: unit vectors whose dot product is never below the cosine."""
    first = unit @ turned
    return np.column_stack([first, np.sqrt(np.maximum(0.0, 1.0 - (first * first).sum(axis=1)))])


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


class Chunk:
    """The members of one cell in the order of its tree; a node's members and its children are ranges."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, raw: np.ndarray, short: np.ndarray, nodes: np.ndarray | None = None, radii: np.ndarray | None = None) -> None:
        self.ids, self.weight, self.raw, self.short = ids, weight, raw, short
        self.norm = _length(raw)
        if nodes is None:
            nodes, radii = self._grow()
        self.nodes, self.radii = nodes, radii
        self.start, self.end, self.centre, self.child, self.childs = nodes.T
        self.radius, self.wide = radii.T
        self.near = self.short[self.centre]
        self.unit = self.raw[self.centre] / self.norm[self.centre, None]

    def _grow(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        order, unit, short = np.arange(n), self.raw / self.norm[:, None], self.short
        nodes, radii, k = [[0, n, 0, 0, 0]], [], 0
        while k < len(nodes):
            start, end, centre, *_ = nodes[k]
            members = order[start:end]
            near = _length(short[members] - short[centre])
            radius = float(near.max())
            radii.append((radius, float(_length(unit[members] - unit[centre]).max())))
            k += 1
            if len(members) <= LEAF or radius < SLACK:
                continue
            centres, owner = [centre], np.zeros(len(members), np.int64)
            # the node's centre is the centre of a child too; the others are the members farthest from all so far
            while len(centres) < FAN and near.max() > radius / 2:
                centres.append(int(members[near.argmax()]))
                d = _length(short[members] - short[centres[-1]])
                closer = d < near
                owner[closer], near[closer] = len(centres) - 1, d[closer]
            order[start:end] = members[np.argsort(owner, kind="stable")]
            size = np.bincount(owner, minlength=len(centres))
            nodes[k - 1][3:] = [len(nodes), len(centres)]
            for c, s in zip(centres, size.tolist(), strict=True):
                nodes.append([start, start + s, c, 0, 0])
                start += s
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        table = np.array(nodes, np.int64)
        table[:, 2] = place[table[:, 2]]
        self.ids, self.weight, self.raw, self.short, self.norm = (x[order] for x in (self.ids, self.weight, self.raw, self.short, self.norm))
        return table, np.array(radii)


class Links:
    """Link counts and components of the points of one task."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.cosines = 0

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j))
        self.waiting += len(i)
        if self.waiting > EDGES:
            self.settle()

    def settle(self) -> None:
        """Roots that the edges connect become the smallest of them."""
        if not self.edges:
            return
        i, j = (np.concatenate(x) for x in zip(*self.edges, strict=True))
        self.edges, self.waiting = [], 0
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        self.count[a] += self.weight[b].sum() - (self.weight[a] if same else 0)
        if not same:
            self.count[b] += self.weight[a].sum()
        both = a if same else np.concatenate([a, b])
        self.join(np.full(len(both), both[0]), both)


def _pairs_of_children(one: Chunk, two: Chunk, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children of both nodes against each other; a leaf stands for itself."""
    n, m = np.maximum(one.childs[x], 1), np.maximum(two.childs[y], 1)
    each = n * m
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    i, j = at // np.repeat(m, each), at % np.repeat(m, each)
    left = np.repeat(np.where(one.childs[x] > 0, one.child[x], x), each) + i
    right = np.repeat(np.where(two.childs[y] > 0, two.child[y], y), each) + j
    if same:
        once = (np.repeat(x, each) != np.repeat(y, each)) | (i <= j)
        return left[once], right[once]
    return left, right


def traverse(one: Chunk, two: Chunk, links: Links, cosine: float) -> None:
    """All links between two chunks (within one if they are one object); points of the second follow those of the first."""
    same, base, reach = one is two, 0 if one is two else len(one.ids), math.sqrt(2 - 2 * cosine)
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(x):
        near = _length(one.near[x] - two.near[y]) <= reach + one.radius[x] + two.radius[y] + SLACK
        x, y = x[near], y[near]
        apart, spread = _length(one.unit[x] - two.unit[y]), one.wide[x] + two.wide[y]
        sure = apart + spread <= reach - SLACK
        for a, b in zip(x[sure], y[sure], strict=True):
            links.whole(np.arange(one.start[a], one.end[a]), np.arange(two.start[b], two.end[b]) + base, same and a == b)
        open_ = ~sure & (apart <= reach + spread + SLACK)
        x, y = x[open_], y[open_]
        leaf = (one.childs[x] == 0) & (two.childs[y] == 0)
        leaves.append((x[leaf], y[leaf]))
        x, y = _pairs_of_children(one, two, x[~leaf], y[~leaf], same)
    x, y = (np.concatenate(v) for v in zip(*leaves, strict=True))
    for a in np.unique(x).tolist():
        others = y[x == a]
        mine = np.arange(one.start[a], one.end[a])
        theirs = np.concatenate([np.arange(two.start[b], two.end[b]) for b in others.tolist()])
        itself = np.repeat(same & (others == a), two.end[others] - two.start[others])
        _compare(one, two, mine, theirs, itself, base, links, cosine)


def _compare(one: Chunk, two: Chunk, mine: np.ndarray, theirs: np.ndarray, itself: np.ndarray, base: int, links: Links, cosine: float) -> None:
    """Members of a leaf against members of leaves near it; ``itself`` marks members of the same leaf, taken once."""
    maybe = one.short[mine] @ two.short[theirs].T >= cosine - SLACK
    if itself.any():
        maybe &= ~itself[None, :] | (mine[:, None] < theirs[None, :])
    i, j = np.nonzero(maybe)
    links.cosines += len(i)
    for low in range(0, len(i), 1 << 15):
        a, b = mine[i[low : low + (1 << 15)]], theirs[j[low : low + (1 << 15)]]
        linked = (one.raw[a] * two.raw[b]).sum(axis=1) / (one.norm[a] * two.norm[b]) >= cosine
        a, b = a[linked], b[linked] + base
        np.add.at(links.count, a, links.weight[b])
        np.add.at(links.count, b, links.weight[a])
        links.join(a, b)


def linked(one: Chunk, two: Chunk, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids with links, their link counts and roots (smallest ids), and the number of cosines computed."""
    ids, weight = (one.ids, one.weight) if one is two else (np.concatenate([one.ids, two.ids]), np.concatenate([one.weight, two.weight]))
    links = Links(weight)
    traverse(one, two, links, cosine)
    links.settle()
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, links.root, ids)
    some = np.flatnonzero(links.count)
    return ids[some], links.count[some], least[links.root[some]], links.cosines


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & (length > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _described(distinct: DataFrame) -> DataFrame:
    """Adds ``z``, the description. The rotation is fitted on a bounded sample of the most frequent length of vectors."""
    common = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").head()
    fitted: dict[int, np.ndarray] = {}
    if common is not None and common["dim"] <= SAMPLE:
        rows = distinct.filter(F.col("dim") == common["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(min(SAMPLE, SAMPLE_NUMBERS // common["dim"] + 1)).select("v").collect()
        sample = np.array([r["v"] for r in rows], float)
        fitted[common["dim"]] = directions(sample / _length(sample)[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                raw = _matrix(batch.column("v").take(pa.array(at)), len(at))
                turned = fitted[dim] if dim in fitted else any_directions(dim)
                for i, z in zip(at.tolist(), described(raw / _length(raw)[:, None], turned), strict=True):
                    out[i] = z
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "z"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.mapInArrow(run, f"{kind}, z array<double>")


def _to_pivots(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Nearest pivot and its distance for the rows of one lane of a cell; equally near pivots share rows. A cell that drew none stays."""
    rep, n = left.column("rep").to_numpy(), left.num_rows
    if not n or not right.num_rows:
        cell, far = left.column("cell").to_numpy(), np.full(n, 2.0)
    else:
        right = right.sort_by("p_rep")
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * _matrix(left.column("z"), n) @ _matrix(right.column("p_z"), right.num_rows).T))
        nearest = apart.argmin(axis=1)
        tied = apart <= apart.min(axis=1)[:, None] + 1e-9
        for i in np.flatnonzero(tied.sum(axis=1) > 1).tolist():
            some = np.flatnonzero(tied[i])
            nearest[i] = some[int(rep[i]) * 0x9E3779B1 % 0xFFFFFFFB % len(some)]
        cell, far = right.column("p_rep").to_numpy()[nearest], apart[np.arange(n), nearest]
    keep = [c for c in left.schema.names if c != "_lane"]
    return pa.table({**{c: left.column(c) for c in keep}, "to": pa.array(cell, pa.int64()), "far": pa.array(far, pa.float64())})


def _levels(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows with their leaf cell (``level``, ``cell``), the table of nodes below the roots, and the number of levels."""
    rows = stored(rows.withColumns({"level": F.lit(0), "cell": F.lit(0).cast("long")}), "cells")
    done, nodes, level = [], [], 0
    while True:
        big = stored(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk), "sizes")
        n_big = big.count()
        if not n_big:
            break
        small = lambda t, n_big=n_big: F.broadcast(t) if n_big <= FEW_CELLS else t
        done.append(rows.join(small(big.drop("_n")), list(NODE), "left_anti").select(rows.columns))
        lanes = F.ceil(F.col("_n") / (4 * chunk)).cast("int")
        inside = rows.join(small(big), list(NODE)).withColumn("_lanes", lanes)
        wanted = F.least(F.greatest(F.ceil(2 * F.col("_n") / chunk), F.lit(4)), F.lit(PIVOTS))
        drawn = inside.filter(F.pmod(F.xxhash64("rep", F.lit(level)), F.col("_n")) < wanted)
        pivots = stored(drawn.select(*[F.col(c).alias(f"p_{c}") for c in (*NODE, "rep", "z")], "_lanes"), "pivots")
        spread = pivots.withColumn("p_lane", F.explode(F.sequence(F.lit(0), F.col("_lanes") - 1))).drop("_lanes")
        laned = inside.withColumn("_lane", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_lanes")).cast("int")).drop("_n", "_lanes")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(laned.drop("_lane").columns).schema)
        moved = laned.groupBy(*NODE, "_lane").cogroup(spread.groupBy(*[f"p_{c}" for c in NODE], "p_lane")).applyInArrow(_to_pivots, f"{kind}, to long, far double")
        level += 1
        moved = stored(moved, f"level{level}")
        radii = moved.groupBy("label", "dim", F.col("cell").alias("parent"), F.col("to").alias("cell")).agg(F.max("far").alias("radius"))
        points = pivots.select(F.col("p_label").alias("label"), F.col("p_dim").alias("dim"), F.col("p_cell").alias("parent"), F.col("p_rep").alias("cell"), F.col("p_z").alias("z"))
        nodes.append(stored(radii.join(points, ["label", "dim", "parent", "cell"], "left").withColumn("level", F.lit(level)), "nodes"))
        rows = moved.withColumns({"level": F.lit(level), "cell": F.col("to")}).select(rows.columns)
    out, table = rows, None
    for d in done:
        out = out.unionByName(d)
    # the last rows are those of the last level, big cells of earlier levels have moved on
    for t in nodes:
        table = t if table is None else table.unionByName(t)
    return out, table, level


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _cell_pairs(labels: DataFrame, nodes: DataFrame | None, levels: int, cosine: float) -> DataFrame:
    """Pairs of leaf cells that may hold links: node pairs of the upper levels, traversed level by level from the roots."""
    pairs = labels.withColumns({f"{n}{k}": F.lit(0).cast(t) for k in "12" for n, t in (("level", "int"), ("cell", "long"))})
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    pairs = pairs.withColumns({f"{n}{k}": F.lit(None).cast(t) for k in "12" for n, t in (("z", "array<double>"), ("radius", "double"))})
    for level in range(1, levels + 1):
        below = nodes.filter(F.col("level") == level)
        for k in "12":
            kids = below.select("label", "dim", F.lit(level - 1).alias(f"level{k}"), F.col("parent").alias(f"cell{k}"), F.lit(level).alias("_level"), F.col("cell").alias("_cell"), F.col("z").alias("_z"), F.col("radius").alias("_radius"))
            pairs = pairs.withColumn("_same", (F.col("level1") == F.col("level2")) & (F.col("cell1") == F.col("cell2"))) if k == "1" else pairs
            joined = pairs.join(kids, ["label", "dim", f"level{k}", f"cell{k}"], "left")
            pairs = joined.withColumns({f"{n}{k}": F.coalesce(f"_{n}", f"{n}{k}") for n in ("level", "cell", "z", "radius")}).drop("_level", "_cell", "_z", "_radius")
        once = ~F.col("_same") | (F.col("cell1") <= F.col("cell2"))
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * _dot(F.col("z1"), F.col("z2"))))
        meet = F.coalesce(apart <= F.col("radius1") + F.col("radius2") + reach, F.lit(True))
        pairs = stored(pairs.filter(once & meet).drop("_same"), "pairs")
    return pairs.select("label", "dim", "level1", "cell1", "level2", "cell2")


def _stored_chunks(rows: DataFrame) -> DataFrame:
    """One row a leaf cell: its members in tree order and its tree."""
    single = dict(rows.dtypes)["v"] == "array<float>"

    def build(_: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        n = group.num_rows
        c = Chunk(group.column("rep").to_numpy(), group.column("weight").to_numpy(), _matrix(group.column("v"), n), _matrix(group.column("z"), n))
        parts = {"ids": c.ids, "weight": c.weight, "raw": c.raw.astype(np.float32 if single else float), "short": c.short, "nodes": c.nodes, "radii": c.radii}
        own = {k: group.column(k).slice(0, 1) for k in NODE}
        return pa.table({**own, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in NODE) + "".join(f", {k} binary" for k in ("ids", "weight", "raw", "short", "nodes", "radii"))
    return rows.select(*NODE, "rep", "weight", "v", "z").groupBy(*NODE).applyInArrow(build, schema)


def threshold_join(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``. Columns read: ``vec_id, embedding, label``."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("v"))).dropDuplicates(["vec_id", "label", "v"])
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct.withColumn("dim", F.size("v")), "distinct")
    single = dict(distinct.dtypes)["v"] == "array<float>"
    cut, nodes, levels = _levels(_described(distinct), chunk)
    pairs = _cell_pairs(distinct.select("label", "dim").distinct(), nodes, levels, cosine)
    chunks = stored(_stored_chunks(cut), "chunks")

    both = F.when((F.col("level1") == F.col("level2")) & (F.col("cell1") == F.col("cell2")), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    sides = pairs.withColumn("side", F.explode(both))
    sides = sides.withColumns({c: F.when(F.col("side") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("level", "cell")})
    work = sides.join(chunks, list(NODE)).drop("level", "cell")

    def run(_: tuple, group: pa.Table) -> pa.Table:
        group, found = group.sort_by("side"), []
        for k in range(group.num_rows):
            get = lambda c, t, k=k: np.frombuffer(group.column(c)[k].as_py(), t)
            ids = get("ids", np.int64)
            found.append(Chunk(ids, get("weight", np.int64), get("raw", np.float32 if single else float).astype(float).reshape(len(ids), -1), get("short", float).reshape(len(ids), -1), get("nodes", np.int64).reshape(-1, 5), get("radii", float).reshape(-1, 2)))
        ids, count, root, _ = linked(found[0], found[-1], cosine)
        return pa.table({"rep": pa.array(ids, pa.int64()), "links": pa.array(count, pa.int64()), "root": pa.array(root, pa.int64())})

    found = stored(work.groupBy("label", "dim", "level1", "cell1", "level2", "cell2").applyInArrow(run, "rep long, links long, root long"), "found")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()
    ends = edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct()
    components = connected_components(ends, edges, "rep", "component_id")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = distinct.select("label", "v", "rep", "weight").join(sums, "rep", "left").join(components, "rep", "left")
    members = good.join(known, ["label", "v"]).groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component_id", "rep")).alias("component_id")
    )
    out = rows.select("vec_id").join(members, "vec_id", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "vec_id")})
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
