"""Byte-level BPE of whole texts by tree concatenation, exactly as the tokenizers library gives it.

A text is halved until a part is short; the parts are encoded independently (long texts in different tasks) and joined
pairwise up the tree. At a join the text around the cut is encoded again in a window that grows until both sides agree:
the window begins at a word start that the left side has settled, and ends where one of its settled word starts is also a
word start of the right side; from there on the right side stands. A word that reaches far to both sides (text that is not
split at all) is joined on its BPE tokens: a window of tokens around the cut, grown until its first tokens equal the left
side's and its last the right side's. Neighbouring tokens that are the encoding of their own concatenation are valid
anywhere, so the joined sequence is the encoding of the whole.

Defined cases: a null or empty text has no ids and decodes to the empty text; equal texts give equal rows; repeated rows
stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import shuffle_parts, small_batches, whole_text
from sigloom.llm.token_cache import byte_letters, chunk_encoder, plain_tokenizer

LEAF_CHARS = 8192
SPREAD_CHARS = 1 << 16
WINDOW_CHARS = 64
UNSPLIT_CHARS = 1 << 12
# more than the longest special token and than what a word looks ahead, in characters
MARGIN = 16
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass
class Part:
    """Ids of a text, with the character and id positions of some of its word starts (always position 0)."""

    ids: np.ndarray
    starts: np.ndarray  # characters, ascending
    at: np.ndarray  # ids before each start


def _settled(ids: list[int], words: list[int], offsets: list[tuple[int, int]]) -> Part:
    w = np.array(words, np.int64)
    first = np.flatnonzero(np.diff(w, prepend=-1)) if len(w) else np.zeros(0, np.int64)
    chars = np.array([offsets[i][0] for i in first], np.int64)
    if not len(first):
        return Part(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64))
    return Part(np.array(ids, np.uint32), chars, first)


class TreeEncoder:
    def __init__(self, name: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS, unsplit: int = UNSPLIT_CHARS) -> None:
        import regex

        self.name, self.leaf, self.window, self.unsplit = name, max(leaf, 2), window, unsplit
        self.tok = plain_tokenizer(name)
        self.pieces = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # fixed value: the word pattern of the vocabulary
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def part(self, text: str) -> Part:
        """One short text, with its word starts."""
        e = self.tok.encode(text, add_special_tokens=False)
        return _settled(e.ids, e.word_ids, e.offsets)

    def join(self, text: str, cut: int, left: Part, right: Part) -> Part:
        """Encoding of ``text`` from those of its two sides."""
        if not cut or cut == len(text):
            return right if not cut else left
        k = max(0, int(np.searchsorted(left.starts, cut - MARGIN, "right")) - 1)
        begin, reach = int(left.starts[k]), self.window
        while True:
            end = min(len(text), max(cut, begin) + MARGIN + reach)
            if end - begin > self.unsplit and (fused := self._fused(text, cut, left, right)) is not None:
                return fused
            w = self.part(text[begin:end])
            starts = w.starts + begin
            if end == len(text):
                return self._splice(left, k, w, starts, len(w.starts), right, len(right.starts), cut)
            # a start is settled when the word before it has ended within the window, no special token open
            sure = starts[(starts >= cut) & (starts <= end - MARGIN)]
            both = np.intersect1d(sure, right.starts + cut)
            if len(both):
                q = int(both[0])
                return self._splice(left, k, w, starts, int(np.searchsorted(starts, q)), right, int(np.searchsorted(right.starts + cut, q)), cut)
            reach *= 2

    @staticmethod
    def _splice(left: Part, k: int, mid: Part, starts: np.ndarray, m: int, right: Part, r: int, cut: int) -> Part:
        """Left before its word ``k``, the window before its word ``m``, right from its word ``r``."""
        head = int(left.at[k])
        stop = int(mid.at[m]) if m < len(mid.at) else len(mid.ids)
        tail = int(right.at[r]) if r < len(right.at) else len(right.ids)
        ids = np.concatenate([left.ids[:head], mid.ids[:stop], right.ids[tail:]])
        chars = np.concatenate([left.starts[:k], starts[:m], right.starts[r:] + cut])
        at = np.concatenate([left.at[:k], mid.at[:m] + head, right.at[r:] - tail + head + stop])
        return Part(ids, chars, at)

    def _fused(self, text: str, cut: int, left: Part, right: Part) -> Part | None:
        """Join within one word that covers the cut; None where the sides do not hold exactly its two pieces."""
        begin = int(left.starts[-1])
        if begin > max(0, cut - MARGIN):  # what follows may still move this start
            return None
        around = text[max(0, cut - MARGIN) : cut + MARGIN]
        if any(s in around for s in self.special):
            return None
        found = self.word.match(text, begin)
        if found is None or found.end() <= cut:
            return None
        end = found.end()
        behind = text[max(0, end - MARGIN) : end + MARGIN]
        if any(s in behind for s in self.special) or any(s in text[max(0, begin - MARGIN) : begin + MARGIN] for s in self.special):
            return None
        if end - cut == len(text) - cut:
            if len(right.starts) > 1:
                return None
            r, stop = len(right.starts), len(right.ids)
        else:
            if len(right.starts) < 2 or int(right.starts[1]) != end - cut:
                return None
            r, stop = 1, int(right.at[1])
        if self.word.match(text[begin:cut]).end() != cut - begin:
            return None
        first = int(left.at[-1])
        a, b = left.ids[first:], right.ids[:stop]
        take = 8
        while True:
            i, j = min(take, len(a)), min(take, len(b))
            merged = np.array([t.id for t in self.tok.model.tokenize("".join(self.pieces[x] for x in [*a[len(a) - i :], *b[:j]]))], np.uint32)
            left_ok = i == len(a) or (len(merged) > 2 and (merged[:2] == a[len(a) - i :][:2]).all())
            right_ok = j == len(b) or (len(merged) > 2 and (merged[-2:] == b[:j][-2:]).all())
            if left_ok and right_ok:
                break
            take *= 2
        word = np.concatenate([a[: len(a) - i], merged, b[j:]])
        ids = np.concatenate([left.ids[:first], word, right.ids[stop:]])
        chars = np.concatenate([left.starts, right.starts[r:] + cut])
        at = np.concatenate([left.at, right.at[r:] - stop + first + len(word)])
        return Part(ids, chars, at)

    def tree(self, text: str, leaves: Iterator[Part] | None = None) -> Part:
        """Halves down to the leaves, joins on the way up. ``leaves`` gives parts that are already encoded."""
        if len(text) <= self.leaf:
            return next(leaves) if leaves is not None else self.part(text)
        cut = len(text) // 2
        return self.join(text, cut, self.tree(text[:cut], leaves), self.tree(text[cut:], leaves))

    def encode(self, text: str) -> np.ndarray:
        return self.tree(text).ids

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that are a single leaf go to the encoder together."""
        short = [i for i, t in enumerate(texts) if len(t) <= self.leaf]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(short, chunk_encoder(self.name, True).encode([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > self.leaf:
                out[i] = self.tree(t).ids
        return out


class Digester:
    """Digests of ids and of what they decode to. Byte-level tokens are bytes, so decoding joins them; should the bytes not be
    valid UTF-8, the library decodes."""

    def __init__(self, tree: TreeEncoder) -> None:
        byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        self.tok = tree.tok
        self.names = [str(i) for i in range(len(tree.pieces))]
        self.raw = [t.encode() if t in tree.special else b"".join([byte_of[c] for c in t]) for t in tree.pieces]

    def _decoded(self, ids: list[int]) -> bytes:
        raw = b"".join([self.raw[i] for i in ids])
        try:
            raw.decode()
        except UnicodeDecodeError:
            return self.tok.decode(ids, skip_special_tokens=False).encode()
        return raw

    def digests(self, ids: list[np.ndarray]) -> dict[str, list]:
        lists = [x.tolist() for x in ids]
        sha = [hashlib.sha256(",".join([self.names[i] for i in x]).encode()).hexdigest() for x in lists]
        return {"n_tokens": [len(x) for x in lists], "ids_sha256": sha, "decoded_sha256": [hashlib.sha256(self._decoded(x)).hexdigest() for x in lists]}


@functools.cache
def tools(tokenizer: str, leaf: int) -> tuple[TreeEncoder, Digester]:
    """Built once per worker."""
    tree = TreeEncoder(tokenizer, leaf)
    return tree, Digester(tree)


def _leaf_spans(n: int, leaf: int) -> list[tuple[int, int]]:
    """Character spans of the leaves of a text of ``n`` characters."""
    spans, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            spans.append((a, b))
        else:
            stack += [(a + (b - a) // 2, b), (a, a + (b - a) // 2)]
    return spans


def _short_texts(docs: DataFrame, tokenizer: str, leaf: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, digester = tools(tokenizer, leaf)
        for batch in batches:
            got = digester.digests(tree.encode_batch(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(got["n_tokens"], pa.int64())} | {k: got[k] for k in ("ids_sha256", "decoded_sha256")})

    return docs.mapInArrow(run, f"doc_id long, {DIGEST}")


def _long_texts(texts: DataFrame, tokenizer: str, leaf: int) -> DataFrame:
    """Distinct long texts (columns ``key, text``): their leaves are rows that any task may encode, then one join tree a text."""
    parts = shuffle_parts(texts.sparkSession)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = _leaf_spans(len(text), leaf)
                yield pa.RecordBatch.from_pydict({"key": [key] * len(cut), "k": pa.array(range(len(cut)), pa.int32()), "text": [text[a:b] for a, b in cut]})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = tools(tokenizer, leaf)
        for batch in batches:
            made = [tree.part(t) for t in batch.column("text").to_pylist()]
            rows = {"key": batch.column("key"), "k": batch.column("k"), "text": batch.column("text")}
            yield pa.RecordBatch.from_pydict(rows | {c: [getattr(p, c).astype("<u4").tobytes() for p in made] for c in ("ids", "starts", "at")})

    def join(_: tuple, group: pa.Table) -> pa.Table:
        tree, digester = tools(tokenizer, leaf)
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        read = lambda r, c: np.frombuffer(r[c], "<u4")
        leaves = iter([Part(read(r, "ids"), read(r, "starts").astype(np.int64), read(r, "at").astype(np.int64)) for r in rows])
        ids = tree.tree("".join(r["text"] for r in rows), leaves).ids
        got = digester.digests([ids])
        return pa.table({"key": [rows[0]["key"]], "n_tokens": pa.array(got["n_tokens"], pa.int64())} | {k: got[k] for k in ("ids_sha256", "decoded_sha256")})

    leaves = texts.mapInArrow(spans, "key string, k int, text string").repartition(parts, "key", "k")
    coded = leaves.mapInArrow(encode, "key string, k int, text string, ids binary, starts binary, at binary")
    return coded.groupBy("key").applyInArrow(join, f"key string, {DIGEST}")


def encode_documents(docs: DataFrame, tokenizer: str, leaf: int = LEAF_CHARS, spread: int = SPREAD_CHARS) -> DataFrame:
    """Per row: ``doc_id``, number of ids, digest of the ids, digest of the decoded text.

    Texts up to ``spread`` characters are encoded where they are read. Longer ones are taken once per distinct text, their
    leaves spread over all tasks, and the digests joined back.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole_text().alias("text"))
    is_long: Column = F.length("text") > spread
    short = _short_texts(rows.filter(~is_long), tokenizer, leaf)
    keyed = rows.filter(is_long).withColumn("key", F.sha2("text", 256))
    coded = _long_texts(keyed.groupBy("key").agg(F.any_value("text").alias("text")), tokenizer, leaf)
    return short.unionByName(keyed.select("doc_id", "key").join(coded, "key").drop("key"))
