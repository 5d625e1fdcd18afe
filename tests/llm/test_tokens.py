"""Encoding, packing and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from sigloom.llm import linear_pack, token_frames, tree_bpe
from sigloom.llm.token_cache import ChunkEncoder, plain_tokenizer

from .cases import awkward, awkward_rows, empty

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ALPHABET = ["a", "b", "the ", "  ", " ", "\n", "é", "日", "1", "22", "!", "...", "'s", "'ll", "<|endoftext|>", "<|", "endoftext", "|>", "́", "\x85", "　", "\t", "zzz"]


def library(name, text):
    return plain_tokenizer(name).encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        pool = rnd.sample(ALPHABET, rnd.randint(1, 6))
        yield "".join(rnd.choice(pool) for _ in range(rnd.choice([1, 3, 30, 120])))


@pytest.mark.parametrize("name,glued", [(BYTE, True), (WORD, False)])
def test_cached_chunks_equal_the_library(name, glued):
    encoder = ChunkEncoder(name, glued, limit=50)
    texts = [*random_texts(300), "İstanbul ΑΣ ŉx ßE aB, cD... e!! f| g' h's İx.", " lead", "trail ", "a  b", "\x1c a\x1d b\x1e!", ""]
    for at in range(0, len(texts), 20):
        some = texts[at : at + 20]
        assert [x.tolist() for x in encoder.encode(some)] == [library(name, t) for t in some]


@pytest.mark.parametrize("leaf,window", [(2, 1), (7, 8), (40, 1)])
def test_tree_equals_the_library(leaf, window):
    tree = tree_bpe.TreeEncoder(BYTE, leaf=leaf, window=window, unsplit=24)
    for text in random_texts(150, leaf):
        assert tree.encode(text).tolist() == library(BYTE, text)


@pytest.mark.parametrize("text", ["a" * 5000, "日本語" * 2000, " " * 3000 + "x", "1234567890" * 900, "abcdefghij" * 1500])
def test_unsplit_text_is_joined_on_tokens(text):
    assert tree_bpe.TreeEncoder(BYTE, leaf=50, unsplit=200).encode(text).tolist() == library(BYTE, text)


def test_encode_documents(spark):
    got = sorted(map(tuple, tree_bpe.encode_documents(awkward(spark), BYTE, leaf=500, spread=2000).collect()), key=str)
    tok, want = plain_tokenizer(BYTE), []
    for doc_id, text, *_ in awkward_rows():
        ids = library(BYTE, text)
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tree_bpe.encode_documents(empty(spark), BYTE).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    manifest = token_frames.write_token_files(awkward(spark), BYTE, 2, rows_per_file=4, frame_tokens=64)
    got = token_frames.read_token_files(manifest).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for doc_id, text, *_ in rows:
        ids = [*library(BYTE, text), 2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    some = token_frames.read_token_files(manifest, wanted=[8, 11]).select("doc_id", "ids_crc32").collect()
    assert {tuple(r) for r in some} == {(w[0], w[3]) for w in want if w[0] in (8, 11)}
    assert token_frames.read_token_files(token_frames.write_token_files(empty(spark), BYTE, 2)).count() == 0


def test_reader_finds_damage(tmp_path):
    path = tmp_path / "a.tok"
    with open(path, "wb") as f:
        w = token_frames.FrameWriter(f, np.dtype("<u2"), frame_tokens=10)
        for k in range(5):
            w.add(k, np.arange(7 * k, dtype="<u2"))
        w.close()
    raw = bytearray(path.read_bytes())
    with open(path, "rb") as f:
        r = token_frames.FrameReader(f, len(raw))
        assert [r.ids(i).tolist() for i in (4, 0, 2)] == [list(range(28)), [], list(range(14))]
        r.table[1, 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            r.frame(1)


def packed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    capacity = 128
    rows = linear_pack.pack_documents(awkward(spark), WORD, 1, capacity).collect()
    want = []
    for doc_id, text, *_ in awkward_rows():
        ids = [*library(WORD, text), 1]
        want += [(doc_id, k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    assert packed_well(rows, capacity) <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert linear_pack.pack_documents(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("lengths", [[60] * 500, [1] * 1000, [51] * 99, [100] * 7, [40, 35, 25] * 200 + [3] * 50])
def test_pack_needs_few_sequences(spark, lengths):
    pieces = spark.createDataFrame([(i, 0, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    rows = linear_pack.pack(pieces, 100).collect()
    assert len(rows) == len(lengths)
    best = {60: 500, 1: 10, 51: 99, 100: 7, 40: -(-sum(lengths) // 100) + 1}[lengths[0]]
    assert packed_well(rows, 100) <= best


def test_configurations_cover_the_demand():
    chosen = linear_pack.configurations([70, 45, 30, 25], [10, 33, 41, 18], 100)
    total = sum(np.array(c) * n for c, n in chosen)
    assert total.tolist() == [10, 33, 41, 18] and all((c * np.array([70, 45, 30, 25])).sum() <= 100 for c, _ in chosen)
