"""Chat formatting in budgeted windows with a loss mask.

A conversation becomes windows of whole turns. Running sums of turn tokens decide where a window ends: the longest run of
new turns that fits the budget beside what is repeated, at least one. Every window after the first begins with the system
turn (when the conversation opens with one) and as many of the latest turns before it as fit the history budget; repeated
turns are context, so their targets are masked. The mask covers exactly the texts of assistant turns, each once.

Template: ``<|im_start|>role``, a new line, the text, ``<|im_end|>`` and a new line. Inside texts and roles a ``<`` with any
number of backslashes and a ``|`` behind it gets one backslash more, so a control string never occurs in them and is
restored exactly; a role's backslashes and line breaks are escaped too.

One pass over rows sorted by conversation and turn; a task holds a window, never a conversation, so a very long one is
streamed. Defined cases: null texts and roles are empty; turns with the same number are ordered by role, then text, and
repeated rows stay; null numbers come first; null conversation ids form one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import shuffle_parts, small_batches

BUDGET = 384
HISTORY = 128
# fixed control strings of the template
START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window long, n_repeated int, n_turns int, formatted string, mask array<struct<start:int,end:int>>"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tokens(role: str, text: str) -> int:
    """Size of a formatted turn: blank-separated words and the template's marks. Any additive count will do."""
    return len(role.split()) + len(text.split()) + 4


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


class Windower:
    """Turns of one conversation in, windows out."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: Turn | None = None
        self.recent: deque[Turn] = deque()
        self.recent_tokens = self.number = self.seen = 0
        self._open([])

    def _open(self, repeated: list[Turn]) -> None:
        self.repeated, self.new = repeated, []
        self.total = sum(t.tokens for t in repeated)

    def add(self, turn: Turn) -> Iterator[dict]:
        if self.new and self.total + turn.tokens > self.budget:
            yield self._close()
            room = min(self.history, self.budget - turn.tokens - (self.system.tokens if self.system else 0))
            kept: list[Turn] = []
            for t in reversed(self.recent):
                if t.tokens > room:
                    break
                kept.insert(0, t)
                room -= t.tokens
            self._open(([self.system] if self.system else []) + kept)
        first = not self.seen
        self.seen += 1
        self.new.append(turn)
        self.total += turn.tokens
        if first and turn.role == "system":
            self.system = turn
            return
        self.recent.append(turn)
        self.recent_tokens += turn.tokens
        while len(self.recent) > 1 and self.recent_tokens - self.recent[0].tokens >= self.history:
            self.recent_tokens -= self.recent.popleft().tokens

    def _close(self) -> dict:
        out, at, mask = [], 0, []
        for k, t in enumerate(self.repeated + self.new):
            head, body = f"{START}{escape_role(t.role)}\n", escape(t.text)
            if k >= len(self.repeated) and t.role == "assistant":
                mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
            piece = f"{head}{body}{END}\n"
            at += len(piece)
            out.append(piece)
        row = {"conv_id": self.conv_id, "window": self.number, "n_repeated": len(self.repeated), "n_turns": len(self.new), "formatted": "".join(out), "mask": mask}
        self.number += 1
        return row

    def end(self) -> Iterator[dict]:
        if self.new:
            yield self._close()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 200) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations; those of one conversation follow one another in one partition."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(4 * shuffle_parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[dict]:
            now: Windower | None = None
            for batch in batches:
                for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            yield from now.end()
                        now = Windower(conv_id, budget, history)
                    yield from now.add(Turn(role, text, turn_tokens(role, text)))
            if now is not None:
                yield from now.end()

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("mask", kind)])
        yield from _batches(windows(), schema)

    return rows.mapInArrow(run, WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted window, unescaped."""
    out = []
    for piece in formatted.split(START)[1:]:
        head, _, body = piece.partition("\n")
        out.append((unescape_role(head), unescape(body[: body.index(END)])))
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of every conversation from its stored windows, in whatever order and partitions these come."""
    ordered = windows.repartition(4 * shuffle_parts(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now: dict | None = None
            for batch in batches:
                for w in batch.to_pylist():
                    if now is None or now["conv_id"] != w["conv_id"]:
                        if now is not None:
                            yield close(now)
                        now = {"conv_id": w["conv_id"], "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
                    for role, text in parse(w["formatted"])[w["n_repeated"] :]:
                        now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        now["n_turns"] += 1
                    for m in w["mask"]:
                        text = unescape(w["formatted"][m["start"] : m["end"]])
                        now["loss"].update(text.encode("utf-8", "surrogatepass"))
                        now["loss_chars"] += len(text)
                    now["formatted_chars"] += len(w["formatted"])
                    now["n_windows"] += 1
            if now is not None:
                yield close(now)

        def close(x: dict) -> dict:
            return {k: v for k, v in x.items() if k not in ("turns", "loss")} | {"turns_sha256": x["turns"].hexdigest(), "loss_sha256": x["loss"].hexdigest()}

        longs = [(c, pa.int64()) for c in ("conv_id", "n_turns")] + [("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
        yield from _batches(rows(), pa.schema(longs), 1000)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
