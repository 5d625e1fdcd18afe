"""Exact token ids of whole texts from a public tokenizer, with a bounded cache of blank-separated chunks.

A tokenizer whose words never cross a blank gives the same ids for a text as for its chunks one after the other, so a
chunk is encoded once per worker and looked up afterwards. Texts with a chunk for which that is not certain (white space
next to a blank) are encoded whole.
"""

from __future__ import annotations

import functools
import string
import unicodedata
from collections.abc import Sequence

import numpy as np

CACHE_CHUNKS = 300_000
#: share of chunks that a full cache may miss before it starts anew
STALE = 0.4
MISSES_AT_ONCE = 20_000
#: marks that close a word and never begin a contraction
MARKS = string.punctuation.replace("'", "")
#: letters up to here are classed alike by every Unicode version
LATIN_END = chr(0x250)


@functools.cache
def plain_tokenizer(name: str):
    """The named public tokenizer without truncation and padding; ``name`` may also be a path."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ChunkEncoder:
    """Encodes batches of texts. ``glued``: a word takes the blank before it (byte-level vocabularies).

    The cache keeps the first ``limit`` chunks, which hold the frequent ones; later ones live for a batch. A full cache that
    misses much of a batch (another language, say) starts anew.
    """

    def __init__(self, name: str, glued: bool, limit: int = CACHE_CHUNKS) -> None:
        self.tok, self.glued, self.limit = plain_tokenizer(name), glued, limit
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}
        self.tokenize = self.tok.model.tokenize
        self.raw = [self.kind.type(i).tobytes() for i in range(self.tok.get_vocab_size())]

    def _model(self, word: str, blank: bool) -> bytes:
        raw = self.raw
        shown = word if word.isascii() else "".join([byte_letters()[b] for b in word.encode()])
        return b"".join([raw[t.id] for t in self.tokenize("\u0120" + shown if blank else shown)])

    def _closing(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = b"".join([self.raw[t.id] for t in self.tokenize(marks)])
        return self.marks[marks]

    def _plain(self, chunk: str, blank: bool) -> bytes | None:
        """Ids of Latin letters that may end in marks, straight from the model; None for any other chunk.

        A single line break between two such pieces is a word of its own.
        """
        stem = chunk.rstrip(MARKS)
        if not stem.isalpha():
            if self.glued and "\n" in chunk:
                parts = [self._plain(part, blank and not i) for i, part in enumerate(chunk.split("\n"))]
                return None if None in parts else self._closing("\u010a").join(parts)
            return None
        lower = stem if self.glued else stem.lower()
        if not stem.isascii() and (max(stem) >= LATIN_END or not (self.glued or (unicodedata.is_normalized("NFC", stem) and lower.isalpha()))):
            return None
        if len(chunk) == len(stem):
            return self._model(lower, blank)
        ids = (self.known.get(stem) if blank == self.glued else None) or self._model(lower, blank)
        return ids + self._closing(chunk[len(stem) :]) if len(chunk) - len(stem) <= 64 else None

    def _learned(self, chunks: list[str]) -> dict[str, bytes | bool]:
        out: dict[str, bytes | bool] = {}
        blank, missing, plain = " " if self.glued else "", [], self._plain
        for w in chunks:
            if (ids := plain(w, self.glued)) is None:
                missing.append(w)
            else:
                out[w] = ids
        for at in range(0, len(missing), MISSES_AT_ONCE):
            part = missing[at : at + MISSES_AT_ONCE]
            got = self.tok.encode([blank + w for w in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype=self.kind).tobytes()
            word = np.array(got.word_ids, dtype=np.int64)
            ends = np.cumsum(np.bincount(word, minlength=len(part))) * self.kind.itemsize
            begin = 0
            for w, end in zip(part, ends.tolist(), strict=True):
                sure = not self.glued or (w and not w[0].isspace() and not w[-1].isspace())
                out[w] = ids[begin:end] if sure else False
                begin = end
        return out

    def _lookup(self, chunks: list[str]) -> list[bytes | bool]:
        found = list(map(self.known.get, chunks))
        if None in found:
            holes = [i for i, v in enumerate(found) if v is None]
            full = len(self.known) >= self.limit
            if full and len(holes) > STALE * len(chunks):
                self.known, full = {}, False
            fresh = self._learned(list(dict.fromkeys([chunks[i] for i in holes])))
            if not full:
                self.known.update(fresh)
            for i in holes:
                found[i] = fresh[chunks[i]]
        return found

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        split = [(t if self.glued else t.replace("\n", " ")).split(" ") for t in texts]
        flat: list[str] = []
        for s in split:
            flat += s[1:] if self.glued else s
        found = self._lookup(flat)
        heads = self.tok.encode([s[0] for s in split], is_pretokenized=True, add_special_tokens=False) if self.glued and split else None
        if heads is not None:
            head_ids, word = np.array(heads.ids, self.kind), np.array(heads.word_ids, np.int64)
            cut = np.searchsorted(word, np.arange(len(split) + 1))
        out, at = [], 0
        for i, (text, s) in enumerate(zip(texts, split, strict=True)):
            n = len(s) - self.glued
            own = found[at : at + n]
            at += n
            whole = self.glued and n > 0 and (not s[0] or s[0][-1].isspace())
            if not whole:
                try:
                    ids = np.frombuffer(b"".join(own), self.kind)
                    out.append(np.concatenate([head_ids[cut[i] : cut[i + 1]], ids]) if self.glued else ids)
                    continue
                except TypeError:  # a chunk that is only certain within its text
                    pass
            out.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind))
        return out


@functools.cache
def chunk_encoder(name: str, glued: bool) -> ChunkEncoder:
    return ChunkEncoder(name, glued)
