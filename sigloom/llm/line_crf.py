"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of letters, capitals, marks and digits, word variety and
repetition within its document, together with those of the line before and after it. Forward-backward gives each line's
marginal; the length-weighted mean over a document is its evidence, which a logistic curve turns into the score.

Labels exist per document only, so every line of a training document carries its document's label and the chain learns how
much lines agree. The fit uses a bounded sample: ``TRAIN_DOCS`` labelled documents in hash order, each with at most
``TRAIN_WINDOWS`` windows of ``WINDOW_LINES`` lines spread over the whole text. Scores use every line of every text;
labels, language, source and ids are never inputs.

Defined cases: a null or empty text is one empty line and gets a score as any other; equal texts get equal scores; repeated
rows stay; without a labelled document of both classes the score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import small_batches, stored, whole_text

TRAIN_DOCS = 6000
TRAIN_WINDOWS = 4
WINDOW_LINES = 48
STEPS = 250
RATE = 0.08
RIDGE = 2e-3
FEATURES = 14
_DIGIT = string.digits.encode()
_UPPER = string.ascii_uppercase.encode()
_LOWER = string.ascii_lowercase.encode()
_ENDS = b".,;:'\"-()?"
_SIGNS = bytes(c for c in string.punctuation.encode() if c not in _ENDS)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) matrix of one text and the length of every line."""
    lines = text.split("\n")
    seen = Counter(lines)
    rows = []
    for line in lines:
        raw = line.encode("utf-8", "surrogatepass")
        n = max(1, len(raw))
        upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
        digits, signs, ends = len(raw) - len(raw.translate(None, _DIGIT)), len(raw) - len(raw.translate(None, _SIGNS)), len(raw) - len(raw.translate(None, _ENDS))
        words = raw.split()
        k = max(1, len(words))
        letters = max(1, upper + lower)
        rows.append(
            (
                1.0, min(len(raw), 2000) / 500, upper / letters, 10 * min(0.3, signs / n), 5 * min(0.4, digits / n), 5 * min(0.4, ends / n), (upper + lower) / n,
                len(set(words)) / k, min(k, 200) / 50, min(n / k, 20) / 10, float(seen[line] > 1 and bool(words)), float(raw[-1:] in (b".", b"?", b'"')),
                float(2 * sum(not w.isalnum() for w in words) > k), float(not words),
            )
        )
    return np.array(rows, np.float32), np.array([max(1, len(s)) for s in lines], np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    edge = np.zeros((1, x.shape[1]), x.dtype)
    return np.concatenate([x, np.concatenate([edge, x[:-1]]), np.concatenate([x[1:], edge])], axis=1)


@dataclass
class LineCrf:
    """``weights`` score a good line against a bad one; ``moves[a, b]`` a step from label a to b (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def chain(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded (documents, lines) scores -> good marginals, pair marginals summed by step, log partition."""
        n, t = scores.shape
        emit = np.stack([np.zeros_like(scores), scores], axis=2)
        ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = emit[:, 0]
        for k in range(1, t):
            step = np.logaddexp(ahead[:, k - 1, :1] + self.moves[0], ahead[:, k - 1, 1:] + self.moves[1]) + emit[:, k]
            ahead[:, k] = np.where((k < lengths)[:, None], step, ahead[:, k - 1])
        for k in range(t - 2, -1, -1):
            after = back[:, k + 1] + emit[:, k + 1]
            step = np.logaddexp(after[:, :1] + self.moves[:, 0], after[:, 1:] + self.moves[:, 1])
            back[:, k] = np.where((k + 1 < lengths)[:, None], step, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        good = np.exp(np.minimum(0.0, ahead[:, :, 1] + back[:, :, 1] - total[:, None]))
        pairs = np.zeros((n, 2, 2))
        for k in range(1, t):
            live = k < lengths
            if live.any():
                after = emit[live, k] + back[live, k]
                pairs[live] += np.exp(np.minimum(0.0, ahead[live, k - 1, :, None] + self.moves + after[:, None, :] - total[live, None, None]))
        return good, pairs, total

    def marginals(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line; documents of similar length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(documents)
        order = sorted(range(len(documents)), key=lambda i: len(documents[i]))
        at = 0
        while at < len(order):
            limit = max(16, 2 * len(documents[order[at]]))
            end = at
            while end < len(order) and len(documents[order[end]]) <= limit:
                end += 1
            some = order[at:end]
            lengths = np.array([len(documents[i]) for i in some])
            scores = np.zeros((len(some), lengths.max()))
            for r, i in enumerate(some):
                scores[r, : lengths[r]] = with_neighbours(documents[i]) @ self.weights
            good = self.chain(scores, lengths)[0]
            for r, i in enumerate(some):
                out[i] = good[r, : lengths[r]]
            at = end
        return out

    def evidence(self, documents: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean marginal as log odds."""
        mean = np.array([float(np.average(m, weights=s)) for m, s in zip(self.marginals(documents), sizes, strict=True)])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, documents: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(documents, sizes) + self.shift)))


def fit(windows: list[np.ndarray], labels: np.ndarray) -> LineCrf:
    """Penalised maximum likelihood by Adam steps."""
    model = LineCrf(np.zeros(3 * FEATURES), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        model.slope = 0.0
        return model
    lengths = np.array([len(w) for w in windows])
    t = int(lengths.max())
    x = np.zeros((len(windows), t, 3 * FEATURES), np.float32)
    for i, w in enumerate(windows):
        x[i, : lengths[i]] = with_neighbours(w)
    live = np.arange(t)[None, :] < lengths[:, None]
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # classes count alike
    gold_pairs = np.zeros((len(windows), 2, 2))
    gold_pairs[np.arange(len(windows)), labels, labels] = lengths - 1
    state = [np.zeros(3 * FEATURES + 4), np.zeros(3 * FEATURES + 4)]
    for step in range(1, STEPS + 1):
        good, pairs, _ = model.chain((x @ model.weights.astype(np.float32)).astype(float) * live, lengths)
        miss = (labels[:, None] - good) * live * (weight / lengths)[:, None]
        g_w = np.tensordot(miss.astype(np.float32), x, axes=([0, 1], [0, 1])) / len(windows) - RIDGE * model.weights
        g_m = ((gold_pairs - pairs) * (weight / lengths)[:, None, None]).sum(axis=0) / len(windows) - RIDGE * model.moves
        g = np.concatenate([g_w, g_m.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[: 3 * FEATURES]
        model.moves = model.moves + move[3 * FEATURES :].reshape(2, 2)
    return model


def calibrate(model: LineCrf, evidence: np.ndarray, labels: np.ndarray) -> LineCrf:
    """Logistic curve by Newton steps, with a small penalty against separable samples."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * evidence).sum() - 1e-2 * a, (labels - p).sum() - 1e-2 * b])
        h = np.array([[(w * evidence**2).sum() + 1e-2, (w * evidence).sum()], [(w * evidence).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's text modulo 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> LineCrf:
    """Fit on a bounded sample of labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # one text an id, so at most `train_docs` rows whatever repeats
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    texts = stored(texts.select("text", "quality"), "training")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"quality": [], "windows": []}
            for text, quality in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                x, _ = line_features(text)
                k = -(-len(x) // WINDOW_LINES)
                picked = range(k) if k <= TRAIN_WINDOWS else [i * k // TRAIN_WINDOWS for i in range(TRAIN_WINDOWS)]
                at = np.concatenate([np.arange(i * WINDOW_LINES, min(len(x), (i + 1) * WINDOW_LINES)) for i in picked])
                rows["quality"].append(quality)
                rows["windows"].append(x[at].tobytes())
            yield pa.RecordBatch.from_pydict({"quality": pa.array(rows["quality"], pa.int32()), "windows": pa.array(rows["windows"], pa.binary())})

    got = texts.mapInArrow(read, "quality int, windows binary").collect()  # bounded by the parameters above
    got.sort(key=lambda r: bytes(r["windows"]))  # the fit does not depend on the order of tasks
    documents = [np.frombuffer(bytes(r["windows"]), np.float32).reshape(-1, FEATURES) for r in got]
    quality = np.array([r["quality"] for r in got], np.int64)
    windows = [(d[a : a + WINDOW_LINES], q) for d, q in zip(documents, quality, strict=True) for a in range(0, len(d), WINDOW_LINES)]
    model = fit([w for w, _ in windows], np.array([q for _, q in windows], np.int64))
    if not model.slope:
        return model

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t) for t in batch.column("text").to_pylist()]
            found = model.evidence([x for x, _ in made], [s for _, s in made]) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(found, pa.float64())], names=["quality", "evidence"])

    # the curve belongs to whole texts, as the scores do; two numbers a training document
    points = sorted((r["evidence"], r["quality"]) for r in texts.select("quality", "text").mapInArrow(whole, "quality int, evidence double").collect())
    return calibrate(model, np.array([e for e, _ in points]), np.array([q for _, q in points], np.int64))


def score_documents(docs: DataFrame, model: LineCrf, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns ``keep`` (all by default) of every document; columns of these names give way."""
    small_batches(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    rows = docs.select(*keep, whole_text().alias("_text_"))
    kind = rows.drop("_text_").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t) for t in batch.column("_text_").to_pylist()]
            score = model.score([x for x, _ in made], [s for _, s in made]) if made else np.zeros(0)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, kind)
