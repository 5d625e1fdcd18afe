"""Token files: independent Zstandard frames, a trailing seek table and a checksum per frame.

A file holds the ids of its documents one after the other, cut into frames of ``FRAME_TOKENS`` ids (little-endian, two or
four bytes). The last data frame is the document index (ids, starts, lengths). A skippable frame with the seek table of
the public Zstandard seekable format ends the file: compressed size, size and the low 32 bits of the XXH64 of every
frame. A reader needs the table, the index and only the frames that its documents touch.

Defined cases: a null text is the empty text (only the end id); a null ``doc_id`` comes first and is read back as null;
repeated rows are written once each; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import shared_folder, shuffle_parts, small_batches, stored, whole_text
from sigloom.llm.token_cache import chunk_encoder

FRAME_TOKENS = 1 << 16
ROWS_PER_FILE = 50_000
LEVEL = 1
DOCS_AT_ONCE = 500
# fixed values of the public seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "part int, path string, n_docs long, n_tokens long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest if rest.startswith('//') else '//' + rest}")


class FrameWriter:
    """Appends documents to one open file."""

    def __init__(self, sink, kind: np.dtype, frame_tokens: int = FRAME_TOKENS) -> None:
        import zstandard

        self.sink, self.kind, self.frame_tokens = sink, np.dtype(kind), frame_tokens
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[tuple[int, int, int, int]] = []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        squeezed = self.pack.compress(raw)
        self.sink.write(squeezed)
        self.table.append((len(squeezed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        at = 0
        while len(ids) - at >= self.frame_tokens or (everything and at < len(ids)):
            self._frame(ids[at : at + self.frame_tokens].tobytes())
            at += self.frame_tokens
        self.waiting = [ids[at:]]
        self.held = max(0, len(ids) - at)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.total, len(ids)))
        self.waiting.append(ids.astype(self.kind, copy=False))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.frame_tokens:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.docs, np.int64).reshape(-1, 4)
        self._frame(struct.pack("<QB", len(index), self.kind.itemsize) + index.T.tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int) -> None:
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the file has no seek table")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.begin = np.concatenate([[0], np.cumsum(self.table[:-1, 1])])
        raw = self.frame(frames - 1)
        n, width = struct.unpack_from("<QB", raw)
        self.kind = np.dtype(f"<u{width}")
        self.doc_id, self.no_id, self.start, self.count = np.frombuffer(raw, "<i8", offset=9).reshape(4, n)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        self.source.seek(int(self.at[k]))
        raw = self.unpack.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.span(int(self.start[i]), int(self.start[i] + self.count[i]))

    def span(self, first: int, stop: int) -> np.ndarray:
        """Ids at the positions ``first`` to ``stop`` of the file; the frame read last is kept."""
        width = self.kind.itemsize
        begin, end = first * width, stop * width
        k, parts = int(np.searchsorted(self.begin, begin, "right")) - 1, []
        while begin < end:
            if self.last[0] != k:
                self.last = (k, self.frame(k))
            low = begin - int(self.begin[k])
            parts.append(self.last[1][low : low + end - begin])
            begin += len(parts[-1])
            k += 1
        return np.frombuffer(b"".join(parts), self.kind)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, rows_per_file: int = ROWS_PER_FILE, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write them in ascending ``doc_id`` order; returns the written manifest.

    One range shuffle of the texts; a task writes one file under a temporary name and renames it, so a repeated attempt
    leaves the same file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "tokens")
    files = max(shuffle_parts(spark), -(-docs.count() // rows_per_file))
    rows = docs.select("doc_id", whole_text().alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, root = _filesystem(folder)
        target, attempt = f"{root}/part-{part:06d}.tok", f"{root}/.attempt-{part:06d}-{uuid.uuid4().hex}"
        encoder, writer, n = chunk_encoder(tokenizer, True), None, 0
        sink = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if texts and writer is None:
                where.create_dir(root, recursive=True)
                sink = where.open_output_stream(attempt)
                writer = FrameWriter(sink, encoder.kind, frame_tokens)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                writer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
            n += len(texts)
        if writer is not None:
            writer.close()
            sink.close()
            where.move(attempt, target)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.tok"], "n_docs": [n], "n_tokens": [writer.total]})

    return stored(rows.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files, or only ``wanted`` ids (a short list), from the frames that hold them.

    ``start`` counts the ids of all documents before, by a running sum over one row per file.
    """
    spark = manifest.sparkSession
    pick = None if wanted is None else np.array(sorted(wanted), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                where, name = _filesystem(path)
                with where.open_input_file(name) as source:
                    reader = FrameReader(source, source.size())
                    chosen = np.arange(len(reader.doc_id)) if pick is None else np.flatnonzero(np.isin(reader.doc_id, pick) & (reader.no_id == 0))
                    for at in range(0, len(chosen), DOCS_AT_ONCE):
                        some = chosen[at : at + DOCS_AT_ONCE]
                        if pick is None:  # neighbours, so their frames are read once
                            low = int(reader.start[some[0]])
                            ids = memoryview(reader.span(low, int(reader.start[some[-1]] + reader.count[some[-1]])).astype("<u4")).cast("B")
                            cuts = zip((4 * (reader.start[some] - low)).tolist(), (4 * reader.count[some]).tolist(), strict=True)
                            crc = [zlib.crc32(ids[a : a + n]) for a, n in cuts]
                        else:
                            crc = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in some]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(reader.doc_id[some], mask=reader.no_id[some].astype(bool)),
                                "start": pa.array(reader.start[some] + before),
                                "n_tokens": pa.array(reader.count[some]),
                                "ids_crc32": pa.array(crc, pa.int64()),
                            }
                        )

    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("before"))
    return files.repartition(2 * shuffle_parts(spark), "part").mapInArrow(read, DOCUMENT)
