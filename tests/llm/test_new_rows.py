"""Decontamination, fill-in-the-middle and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import decontamination, gnat_codes, skip_list_fim

from .cases import awkward, awkward_rows, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        k = min(10, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1):
            if k and tuple(ws[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def contaminated_rows():
    passage, other = prose(31, 40), prose(32, 25)
    items = [(1, passage), (10, passage), (2, other), (3, "Zürich 9 bridges"), (None, prose(33, 12)), (4, None), (5, ""), (6, "!? -"), (7, "日本語"), (2, other), (8, prose(7, 14))]
    texts = [passage, passage.upper() + " tail", "head " + " ".join(passage.split()[:10]), " ".join(passage.split()[3:12]), prose(40, 30) + "\n" + other + "\n" + prose(41, 30), "x zürich-9-BRIDGES, y 日本語!", prose(33, 12), "ZÜRICH 9 bridges", None, ""]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in awkward_rows()]
    return rows, items


@pytest.mark.parametrize("block", [decontamination.BLOCK_PAIRS, 7])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "STEP", 16)
    rows, items = contaminated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"items": F.lit(1), "spans": F.lit("s"), "n_words": F.lit(2)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(0))
    got = decontamination.contamination(docs, bench, block_pairs=block).drop("spans")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *brute_hits(t, items)) for d, t in rows), key=str)
    assert decontamination.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontamination.contamination(docs.filter("false"), bench).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination, "FACTOR", np.uint64(1))
    pairs = [("a b c", "x"), ("c b a", "y"), ("b a c", "z"), ("b", "w")]
    found = decontamination.search([b"A b c. c b a", b"q b a q c a b"], decontamination.WindowSet(pairs))
    assert found == ([6, 7], [[(0, 6)], [(1, 2), (6, 7)]], [["w", "x", "y"], ["w"]])


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_BYTES", 50)
    text, item = prose(3, 900), " ".join(prose(3, 900).split()[400:440])
    assert decontamination.search([text.encode()], decontamination.WindowSet([(" ".join(words(item)[i : i + 10]), "1") for i in range(31)]))[1] == [[(400, 440)]]


def test_decontaminate(spark):
    rows, items = contaminated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"items": F.lit(1), "_c0": F.lit("s")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter("doc_id IS NOT NULL").collect() if r["text"]) == sorted((d, t) for d, t in rows if d is not None and t and not brute_hits(t, items)[4])
    cleaned = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert len(cleaned) == len({d for d, _ in rows}) and cleaned[108] is None and cleaned[100].strip(" .") == ""
    assert cleaned[105] == "x , y !"
    for d, t in rows:
        if d is not None and not brute_hits(t, items)[4]:
            assert cleaned[d] == t
    assert decontamination.decontaminate(docs, bench, "documents", most_share=1.0).count() == len(rows)
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, "words")


def test_skip_list_reaches_every_rank():
    rnd = random.Random(3)
    for n in (0, 1, 2, 5, 64, 3000):
        widths = [rnd.choice([0, 1, 7, 400]) for _ in range(n)]
        units, total = skip_list_fim.SkipList(), 0
        for w in widths:
            units.append(w)
        for rank in range(n + 1):
            assert units.code_points(rank) == total
            total += widths[rank] if rank < n else 0
        with pytest.raises(IndexError):
            units.code_points(n + 1)
    assert 4 <= len(units.units) <= 16


def brute_fim(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(50, "a<P>b\nc"), (51, "\n\n\n"), (52, "line <S\nP>\r\nü日𝄞\nlast <"), (53, "<S" * 9 + "\n" + "P>" * 9), (54, "<M>"), (55, "x\n")] + [(60 + i, prose(i, 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(1), "n": F.lit(2), "_key": F.lit("k")}).repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(d, *(x := brute_fim(d, t))[:4], sha(x[4]), sha(t or "")) for d, t in rows]
    got = skip_list_fim.digests(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    half = skip_list_fim.transformed(docs, ["doc_id", "text"], seed=3, rate=60, spm=20)
    assert sorted(((r["_c0"], *tuple(r)[2:]) for r in half.collect()), key=str) == sorted(((d, *brute_fim(d, t, 60, 20, 3)) for d, t in rows), key=str)
    back = half.select(skip_list_fim.restored(F.col("output"), F.col("form")).alias("r"), F.coalesce("_c1", F.lit("")).alias("t"))
    assert back.filter("r <> t").count() == 0
    assert skip_list_fim.digests(empty(spark)).count() == 0 and skip_list_fim.digests(awkward(spark)).count() == len(awkward_rows())
    with pytest.raises(ValueError):
        skip_list_fim.transformed(docs, [], markers=("<P>", "<P>", "<M>"))


def test_gnat_equals_full_search():
    rnd = np.random.default_rng(6)
    for points, queries in (
        (rnd.integers(-40, 40, (64, 4)), rnd.integers(-50, 50, (2000, 4))),
        (rnd.integers(0, 3, (64, 3)), rnd.integers(0, 3, (500, 3))),
        (np.zeros((40, 2), int), rnd.integers(-2, 2, (50, 2))),
        (rnd.integers(-(1 << 24), 1 << 24, (256, 4)), rnd.integers(-(1 << 24), 1 << 24, (300, 4))),
        (rnd.integers(-9, 9, (1, 4)), rnd.integers(-9, 9, (5, 4))),
    ):
        d = ((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        index, best, _ = gnat_codes.Gnat(points).nearest(queries)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    centres = rnd.integers(-2000, 2000, (16, 4))
    points = (centres[:, None, :] + rnd.integers(-20, 20, (16, 16, 4))).reshape(-1, 4)
    queries = points[rnd.integers(0, 256, 4000)] + rnd.integers(-5, 5, (4000, 4))
    tree = gnat_codes.Gnat(points)
    assert (tree.nearest(queries)[0] == ((queries[:, None, :] - points[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert tree.computed < 0.25 * len(points) * len(queries)


def brute_codes(rows, parts, entries, rounds):
    good = [(i, lab, v) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 65536 and len(v) % parts == 0]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    good = [r for r in good if len(r[2]) == len(good[0][2])]
    x = np.array([np.floor(np.array(r[2], float) * 256) for r in good]).astype(np.int64).reshape(len(good), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        index = assign().argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[index[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    d = assign()
    error = d.min(axis=2).sum(axis=1)
    by = {}
    for (_, lab, _), e in zip(good, error, strict=True):
        by[lab] = by.get(lab, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in c), int(e), by[lab], sha) for (i, lab, _), c, e in zip(good, d.argmin(axis=2), error, strict=True)), key=str)


@pytest.mark.parametrize("labels", [gnat_codes.LABELS, 0])
def test_codes(spark, labels, monkeypatch):
    monkeypatch.setattr(gnat_codes, "LABELS", labels)
    rnd = np.random.default_rng(8)
    rows = [(i, (rnd.normal(size=8) * rnd.choice([0.01, 0.4])).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(200)]
    rows += [rows[5], rows[5], (None, rows[7][1], 0), (3, rows[9][1], 1)]
    rows += [(900, None, 0), (901, [], 0), (902, [float("nan")] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 1), (904, [float("inf")] * 8, 1), (905, [1.0] * 4, 1), (906, [1.0] * 7, 1), (907, [70000.0] * 8, 1), (908, [0.0] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "v": F.lit("v")}).repartition(3)
    for parts, entries, rounds in ((4, 16, 2), (2, 256, 1), (8, 3, 3)):
        assert sorted(map(tuple, gnat_codes.compress(df, parts, entries, rounds).collect()), key=str) == brute_codes(rows, parts, entries, rounds)
    assert gnat_codes.compress(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        gnat_codes.compress(df, entries=300)
