"""Independence groups against brute force, with every block handled by stars."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import fingerprint as fp


def brute(blocks):
    nodes = sorted(blocks)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if len(blocks[a] & blocks[b]) >= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed,density", [(2, 0.06), (5, 0.06), (1000, 0.06), (3, 0.12)])
def test_overlap_components_match_all_pairs(spark, seed, density):
    rng = np.random.default_rng(seed)
    blocks = {n: {int(b) for b in np.flatnonzero(rng.random(40) < density)} | ({100} if n % 3 == 0 else set()) for n in range(60)}
    for n in range(0, 12, 4):
        blocks[n] |= {100, 101}
    rows = [(n, f"b{b}") for n, bs in blocks.items() for b in bs]
    edges = fp.overlap_links(spark.createDataFrame(rows, "n long, b string"), "n", "b")
    nodes = spark.createDataFrame([(n,) for n in blocks], "n long")
    got = {r["n"]: r["root"] for r in fp.connected_components(nodes, edges, "n").collect()}
    assert got == brute(blocks)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 64)]
    star = [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(65), *range(100, 140), 999]], "n long")
    got = {r["n"]: r["root"] for r in fp.connected_components(nodes, spark.createDataFrame(chain + star, "a long, b long"), "n").collect()}
    assert {got[i] for i in range(65)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[999] == 999


def test_copies_form_a_star(spark):
    df = spark.createDataFrame([(i, "same" if i < 50 else f"x{i}") for i in range(60)], "n long, h string")
    links = fp.identical_links(df, "h", "n").collect()
    assert len(links) == 49 and {r["a"] for r in links} == {0}


def test_ambiguity_policy(spark):
    rows = [("s", 0, "A"), ("s", 1, "B"), ("s", 2, "B"), ("s", 3, None), ("t", 0, "C"), ("t", 1, "C"), ("t", 2, "D"), ("t", 3, "C"), ("u", 1, "E")]
    df = spark.createDataFrame(rows, "subject string, trial int, h string")
    out = fp.resolve_ambiguous(df, "subject", "trial", "h", F.col("trial") == 0).collect()
    dropped = {(r["subject"], r["trial"]) for r in out if not r["usable"]}
    assert dropped == {("s", 2), ("t", 0), ("t", 1), ("t", 3)} and len(out) == len(rows)


def test_mixed_groups_are_reported(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "g int, holdout boolean")
    assert [r["g"] for r in fp.mixed_groups(df, "g", F.col("holdout")).collect()] == [1]


def test_owners_of_two_common_blocks_are_a_star(spark):
    rows = [(n, b) for n in range(40) for b in ("x", "y")]
    edges = fp.overlap_links(spark.createDataFrame(rows, "n long, b string"), "n", "b").collect()
    assert len(edges) == 39 and {r["a"] for r in edges} == {0}
