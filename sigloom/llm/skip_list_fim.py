"""Fill-in-the-middle transformation with an indexable skip list over the units of a text.

The units (lines) of a text are the nodes of a skip list whose links carry two widths: how many units and how many code points
they pass. An upper lane's link has the sums of the links below it. The list is entered at the top lane and descended by the
accumulated unit width, which reaches a cut rank in a logarithmic number of steps with the code points before it at hand; both
cuts of a document are found this way, and the text is sliced there. Ranks come from a hash of the document's id, so a lost task
repeats the same cuts. Rows are independent: no shuffle.

Defined cases: a null text is the empty text; empty texts and texts that contain a marker stay plain, with null sizes; a null id
hashes as the word "null"; repeated rows give repeated results; cuts may fall together or at the ends, leaving empty parts; an
empty table gives no rows; other columns are ignored by ``transformed``, which carries the columns it is asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import small_batches

MARKERS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"
SEED = 7
RATE = 100
SPM = 50
MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def height(node: int) -> int:
    """Lanes above the lowest that the node is on: geometric with a quarter, from a hash of its place."""
    x = (node + 1) * MIX & MASK
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 32
    return ((x & -x).bit_length() - 1) // 2 if x else 32


class SkipList:
    """Indexable skip list, filled from the left. Node 0 is the head; a link leads to the node behind its widths."""

    def __init__(self) -> None:
        self.size = self.chars = 0
        # per lane and node on it: units and code points from here to the next node of the lane
        self.units: list[list[int]] = [[]]
        self.points: list[list[int]] = [[]]
        # per lane and node on it: where the node stands in the lane below
        self.below: list[list[int]] = [[]]
        # per lane: width behind its last node
        self.open: list[list[int]] = [[0, 0]]

    def append(self, width: int) -> None:
        """A unit of ``width`` code points at the right end."""
        tower = height(self.size)
        while len(self.units) <= tower:
            self.units.append([])
            self.points.append([])
            self.below.append([])
            self.open.append([self.size, self.chars])
        self.size += 1
        self.chars += width
        for lane, tail in enumerate(self.open):
            tail[0] += 1
            tail[1] += width
            if lane <= tower:
                # the link ends at the new node, whose own place in the lane below is that lane's newest link
                self.units[lane].append(tail[0])
                self.points[lane].append(tail[1])
                self.below[lane].append(len(self.units[lane - 1]) if lane else 0)
                self.open[lane] = [0, 0]

    def code_points(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        units = points = link = 0
        for lane in range(len(self.units) - 1, -1, -1):
            wide, far = self.units[lane], self.points[lane]
            while link < len(wide) and units + wide[link] <= rank:
                units += wide[link]
                points += far[link]
                link += 1
            # behind the last link taken stands a node; go on from its place one lane down
            link = self.below[lane][link - 1] if link and lane else 0
        return points


def ranks(key: str, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Both cut ranks in order, and the two draws that choose the form."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b), h[2] % 100, h[3] % 100


def cut(text: str, key: str, unit: re.Pattern, seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    units = SkipList()
    for m in unit.finditer(text):
        units.append(m.end() - m.start())
    low, high, form, order = ranks(key, units.size, seed)
    if not text or form >= rate or any(m in text for m in markers):
        return units.size, "plain", None, None, text
    a, b = units.code_points(low), units.code_points(high)
    p, s, m = markers
    head, middle, tail = text[:a], text[a:b], text[b:]
    if order < spm:
        return units.size, "spm", a, b - a, "".join((s, tail, p, head, m, middle))
    return units.size, "psm", a, b - a, "".join((p, head, s, tail, m, middle))


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers of the shape <name> cannot arise across the seams of texts that hold none of them."""
    if len(set(markers)) != 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in markers):
        raise ValueError("markers are three different names in angle brackets")


def transformed(documents: DataFrame, keep: list[str], seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = UNIT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Columns ``keep`` as ``_c0, _c1, ..`` with ``n, form, prefix_chars, middle_chars, output``. Units must cover the text."""
    check_markers(markers)
    small_batches(documents.sparkSession)
    pattern = re.compile(unit)
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)]
    rows = documents.select(*carried, F.col("doc_id").cast("string").alias("_key"), F.col("text").alias("_text"))
    types = "".join(f"_c{i} {documents.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("_key").to_pylist(), batch.column("_text").to_pylist()
            done = [cut(t or "", "null" if k is None else k, pattern, seed, rate, spm, markers) for k, t in zip(keys, texts, strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True) if done else ([],) * 5
            kept = [(c, batch.column(c)) for c in batch.schema.names if c.startswith("_c")]
            new = [
                ("n", pa.array(n, pa.int64())), ("form", pa.array(form, pa.string())), ("prefix_chars", pa.array(prefix, pa.int64())),
                ("middle_chars", pa.array(middle, pa.int64())), ("output", pa.array(output, pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + new], names=[c for c, _ in kept + new])

    return rows.mapInArrow(run, f"{types}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from nothing but the output and its form."""
    p, s, m = markers

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, then, 1), first, -1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    rows = transformed(documents, ["doc_id"])
    return rows.select(
        F.col("_c0").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
