"""Quality rules: counted rules, then a hashed word and character n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_text_an_id, rebatched, sampled_by_class, texts, worker_cache

#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 10, 20, 0.3
#: The classifier is fitted on about this many labelled rows of each class at most.
FIT_ROWS = 600
BITS = 15  # of a hashed feature, for words and for characters
SIDE = 1 << BITS
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text. Words are runs without ASCII white space."""
    raw = text.encode("utf-8")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(text) - len(text.translate(SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """How many words stand in windows of k words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    first: dict = {}
    if len(set(windows)) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + k] = covered[j : j + k] = b"\1" * k
    return sum(covered)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values. Words and pairs of words share one half, 3- and 5-byte grams the other; in each half the values sum to 1."""
    raw = text.encode("utf-8")
    out = []
    words = np.fromiter(map(crc32, raw.split()), np.uint32)
    pairs = words[:-1] * np.uint32(0x9E3779B1) + words[1:]
    out.append(np.concatenate([words * np.uint32(0x85EBCA6B), pairs * np.uint32(0xC2B2AE35)]) >> np.uint32(32 - BITS))
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    mul = [np.uint32(x) for x in (0x01000193, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
    grams = [sum((a[i : len(a) - k + 1 + i] * mul[i] for i in range(k)), np.zeros(max(0, len(a) - k + 1), np.uint32)) * np.uint32(0x9E3779B1) for k in (3, 5) if len(a) >= k]
    out.append((np.concatenate(grams) >> np.uint32(32 - BITS)) + np.uint32(SIDE) if grams else np.zeros(0, np.uint32))
    return np.concatenate(out).astype(np.int32), np.concatenate([np.full(len(x), 1 / max(1, len(x)), np.float32) for x in out])


@dataclass
class Model:
    """Weights, bias and Platt's two numbers; score gives the probability of quality 1."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str) -> float:
        idx, val = features(text)
        x = float(np.dot(self.weights[idx], val)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -35, 35))))


#: Documents whose features the fit works on together.
TOGETHER = 100


def _fit(rows: list[tuple[int, bytes, bytes, bool]], weight: dict[int, float]) -> Model:
    """Logistic regression by Adam on the rows (class, packed buckets, packed values, whether it is set aside) that aren't set aside, both classes weighing the same; then Platt scaling on those that are, each class weighing what it has in the corpus."""
    y = np.array([r[0] for r in rows], np.float64)
    all_good = not len(y) or (y * weight.get(1, 1)).sum() >= ((1 - y) * weight.get(0, 1)).sum()
    none = Model(np.zeros(2 * SIDE, np.float32), 0.0, 0.0, 35.0 if all_good else -35.0)
    if len(set(y)) < 2:
        return none
    aside = np.array([r[3] for r in rows])
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    blocks = []
    for s in range(0, len(rows), TOGETHER):
        part = rows[s : s + TOGETHER]
        length = np.array([len(r[1]) // 4 for r in part])
        blocks.append((slice(s, s + len(part)), length, np.frombuffer(b"".join(r[1] for r in part), "<i4"), np.frombuffer(b"".join(r[2] for r in part), "<f4")))
    rows.clear()

    def logits(w: np.ndarray, b: float) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), w[idx] * val, len(n)) for _, n, idx, val in blocks]) + b

    share = np.where(y == 1, 0.5 / max(1, (y[~aside] == 1).sum()), 0.5 / max(1, (y[~aside] == 0).sum())) * ~aside
    w, b = np.zeros(2 * SIDE), 0.0
    m, v = np.zeros(2 * SIDE + 1), np.zeros(2 * SIDE + 1)
    for t in range(1, 81):
        g = (1 / (1 + np.exp(-np.clip(logits(w, b), -35, 35))) - y) * share
        grad = np.append(1e-7 * w, g.sum())
        for at, n, idx, val in blocks:
            grad[:-1] += np.bincount(idx, np.repeat(g[at], n) * val, 2 * SIDE)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - 0.1 * step[-1]
    fit = aside if aside.any() else ~aside
    a, c = _platt(logits(w, b)[fit], y[fit], np.where(y == 1, weight.get(1, 1), weight.get(0, 1))[fit])
    return Model(w.astype(np.float32), float(b), a, c)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted points (z, y), by Newton steps, with Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = weight * (len(y) / weight.sum())
    s = max(float(np.std(z)), 1e-9)
    x = np.stack([z / s, np.ones_like(z)], 1)
    p = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -35, 35)))
        h = x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (q - t)) + 1e-3 * p)
        p = p - np.clip(step, -2, 2)
    return float(max(p[0], 0.0) / s), float(p[1])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on whole texts of about `rows` labelled documents of either class (chosen by hash; a document's largest label counts; of rows that share an id, the least text). The probability is calibrated to the mix of classes of all labels. Features are made on the executors; the driver receives at most that many sparse rows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    sample, weights = sampled_by_class(known, "y", "doc_id", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 200):
            got = []
            for t in texts(batch):
                idx, val = features(t)
                u, at = np.unique(idx, return_inverse=True)
                got.append((u.astype("<i4").tobytes(), np.bincount(at, val).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], ["doc_id", "y", "idx", "val"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # 2 x rows at most, about
    got = [(r.doc_id, r.y, bytes(r.idx), bytes(r.val)) for r in one_text_an_id(joined, "y").mapInArrow(run, "doc_id long, y int, idx binary, val binary").toLocalIterator()]
    got.sort()
    return _fit([(y, idx, val, crc32(str(i).encode()) % 5 == 0) for i, y, idx, val in got], weights)


def quality_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and p_quality of every whole text.

    A narrow pass in Arrow batches. Null and empty texts have no words, so they fail the base rules. Repeated rows give repeated results; other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for batch in rebatched(batches):
            rows = [_judged(t, sent.value, keep_at) for t in texts(batch)]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], NAMES)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality"]


def _judged(text: str, model: Model, keep_at: float) -> tuple:
    c = counts(text)
    failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
    p = model.score(text)
    return (*c, failed, not failed and p >= keep_at, p)


def kept_documents(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for batch in rebatched(batches):
            yield batch.filter(pa.array([_judged(t, sent.value, keep_at)[6] for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
