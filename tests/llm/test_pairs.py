"""Near-duplicate joins against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sigloom.llm import cover_tree, signature_tree

from .cases import WORDS, awkward, awkward_rows, empty, prose


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    known = [(d, s) for d, s in sets if d is not None and s]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[i + 1 :] if 100 * len(x & y) >= 80 * len(x | y)]
    comp = components({d for d, _ in known}, links)
    return sorted(((d, len(s), comp[d] if d in comp and s else d) for d, s in sets), key=str)


def test_awkward_documents(spark):
    got = sorted(map(tuple, signature_tree.near_duplicates(awkward(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in awkward_rows()])
    assert signature_tree.near_duplicates(empty(spark)).count() == 0


def test_near_copies_of_every_strength(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "CHUNK_SHINGLES", 600)
    monkeypatch.setattr(signature_tree, "SMALL_KEY", 6)
    rnd = random.Random(5)
    passage = prose(99, 60)
    rows = []
    for group in range(12):
        base = prose(group, rnd.randint(30, 220)).split()
        for _ in range(rnd.randint(1, 9)):
            words = list(base)
            for _ in range(rnd.randint(0, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS) + str(rnd.randint(0, 9))
            rows.append((len(rows), " ".join(words) + (" " + passage if group % 3 == 0 else "")))
    rows += [(len(rows) + i, t) for i, t in enumerate([rows[0][1]] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, signature_tree.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_even_numbers_of_copies_keep_their_keys(spark):
    rows = []
    for group in range(24):
        words = [f"g{group}w{i}" for i in range(54)]
        first, second = list(words), list(words)
        first[14], second[34] = "changed", "altered"
        # two copies each of two near copies: their digests cancel out of an xor over rows
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([words, [*words, "more"], first, first, second, second])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, signature_tree.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_forest_finds_all_components():
    rnd = np.random.default_rng(2)
    sets = []
    for _ in range(15):
        base = np.unique(rnd.integers(0, 2**63, rnd.integers(20, 200), dtype=np.uint64))
        for _ in range(rnd.integers(1, 12)):
            keep = rnd.random(len(base)) > rnd.choice([0.0, 0.05, 0.1, 0.2])
            sets.append(np.unique(np.concatenate([base[keep], rnd.integers(0, 2**63, rnd.integers(0, 6), dtype=np.uint64)])))
    side = rnd.integers(0, 2, len(sets))
    for s in (None, side):
        links = []
        for i, x in enumerate(sets):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(x, sets[j]))
                if 100 * both >= 80 * (len(x) + len(sets[j]) - both) and (s is None or s[i] != s[j]):
                    links.append((i, j))
        ids = list(range(len(sets)))
        assert components(ids, signature_tree.similar_forest(ids, sets, s)) == components(ids, links)


def vector_rows(seed=1):
    rnd = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rnd.normal(size=8)
            for _ in range(rnd.integers(1, 15)):
                v = centre + rnd.normal(size=8) * rnd.choice([0.0, 0.1, 0.25, 0.4])
                rows.append((len(rows), v.astype(np.float32).tolist(), label))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 8, 0), (n + 3, [float("nan")] + [1.0] * 7, 0), (n + 4, [None] + [1.0] * 7, 0), (n + 5, [float("inf")] * 8, 1), (n + 6, rows[0][1][:4], 0), rows[3]]
    return rows


def brute_vectors(rows):
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links.append((a, b))
    comp = components({r[0] for r in rows}, links)
    return sorted((i, sum(i in x for x in links), comp[i], comp[i] == i) for i, *_ in rows)


def test_vectors_against_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for chunk in (2048, 20):
        assert sorted(map(tuple, cover_tree.threshold_join(df, chunk=chunk).collect())) == brute_vectors(rows)
    assert cover_tree.threshold_join(df.filter("false")).count() == 0


def chunk_of(points, ids=None):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    turned = cover_tree.directions(unit[:500])
    ids = np.arange(len(points)) if ids is None else ids
    return cover_tree.Chunk(ids, np.ones(len(points), np.int64), points, cover_tree.described(unit, turned))


def test_cover_tree_is_nested():
    rnd = np.random.default_rng(4)
    for points in (rnd.normal(size=(900, 6)), np.repeat(rnd.normal(size=(3, 40)), 200, axis=0) + 1e-3 * rnd.normal(size=(600, 40)), np.ones((300, 20)), np.ones((1, 2))):
        c = chunk_of(points)
        unit = c.raw / c.norm[:, None]
        for k in range(len(c.nodes)):
            own = slice(c.start[k], c.end[k])
            assert np.linalg.norm(c.short[own] - c.near[k], axis=1).max() <= c.radius[k] + 1e-12
            assert np.linalg.norm(unit[own] - c.unit[k], axis=1).max() <= c.wide[k] + 1e-12
            kids = range(c.child[k], c.child[k] + c.childs[k])
            if kids:
                assert [c.start[kids[0]], *[c.end[j] for j in kids]] == [c.start[k], *[c.start[j] for j in kids[1:]], c.end[k]]
                assert any(np.array_equal(c.unit[j], c.unit[k]) for j in kids) and len(kids) <= cover_tree.FAN
            else:
                assert c.end[k] - c.start[k] <= cover_tree.LEAF or c.radius[k] < cover_tree.SLACK
        assert sorted(c.ids) == list(range(len(points)))


def full(points, cosine=0.93):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    return near


def test_few_cosines_are_computed():
    rnd = np.random.default_rng(9)
    plain = rnd.normal(size=(2000, 64))
    planted = np.repeat(rnd.normal(size=(100, 64)), 20, axis=0) + 0.15 * rnd.normal(size=(2000, 64))
    tight = np.repeat(rnd.normal(size=(2, 64)), 1000, axis=0) + 0.01 * rnd.normal(size=(2000, 64))
    for points, share in ((plain, 0.02), (planted, 0.05), (tight, 0.05)):
        near = full(points)
        ids, count, root, cosines = cover_tree.linked(c := chunk_of(points), c, 0.93)
        assert dict(zip(ids.tolist(), count.tolist(), strict=True)) == {i: int(n) for i, n in enumerate(near.sum(axis=1)) if n}
        comp = components(range(len(points)), list(zip(*np.nonzero(near), strict=True)))
        assert all(comp[i] == r for i, r in zip(ids.tolist(), root.tolist(), strict=True))
        assert cosines < share * len(points) ** 2 / 2
        one, two = chunk_of(points[:900], np.arange(900)), chunk_of(points[900:], np.arange(900, 2000))
        got = {}
        for x, y in ((one, one), (two, two), (one, two)):
            other = cover_tree.described(points[900:] / np.linalg.norm(points[900:], axis=1, keepdims=True), cover_tree.directions(points[:500] / np.linalg.norm(points[:500], axis=1, keepdims=True)))
            y = cover_tree.Chunk(np.arange(900, 2000), np.ones(1100, np.int64), points[900:], other) if y is two else y
            x = y if x is two else x
            for i, n, *_ in zip(*cover_tree.linked(x, y, 0.93)[:2], strict=True):
                got[int(i)] = got.get(int(i), 0) + int(n)
        assert got == {i: int(n) for i, n in enumerate(near.sum(axis=1)) if n}


def test_equal_descriptions_still_split(spark):
    rows = [(i, ([0.0] * 30 + [1.0, 0.001 * i]), 0) for i in range(120)] + [(200 + i, [1.0 + i] + [0.0] * 31, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"v": F.lit(1), "cell": F.lit("c"), "rep": F.lit(2)})
    assert sorted(map(tuple, cover_tree.threshold_join(df, chunk=10).collect())) == brute_vectors(rows)
