"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then temperature-calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, one_text_an_id, rebatched, sampled_by_class, texts, worker_cache

BITS = 15
SIDE = 1 << BITS
#: The classifier is fitted on about this many rows of each language at most. Document frequencies cover all rows that may be learned from.
FIT_ROWS = 250
UNKNOWN, ACCEPT_AT = "und", 0.3


def grams(text: str) -> np.ndarray:
    """Hash buckets of the 2-, 3- and 4-byte grams of the text in lower case, white space as one space."""
    a = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8"), np.uint8).astype(np.uint32)
    mul = [np.uint32(x) for x in (0x01000193, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
    out = []
    for k in (2, 3, 4):
        if len(a) >= k:
            h = a[: len(a) - k + 1] * mul[0]
            for i in range(1, k):
                h = h + a[i : len(a) - k + 1 + i] * mul[i]
            out.append((h * np.uint32(0x9E3779B1) + np.uint32(k)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """langs in order of their names; idf by bucket; weights by bucket and language."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tf = np.bincount(grams(text), minlength=SIDE)
        idx = np.flatnonzero(tf)
        val = (1 + np.log(tf[idx])) * self.idf[idx]
        return idx, val / max(float(np.sqrt(np.dot(val, val))), 1e-12)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        idx, val = self.vector(text)
        p = _softmax(val @ self.weights[idx] / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, epochs: int = 3) -> np.ndarray:
    """FTRL-proximal over the rows: each step touches a row's own coordinates; l1 keeps weights at zero, l2 shrinks them. State is held for the buckets that some row has."""
    met = np.unique(np.concatenate([idx for idx, _, _ in rows])) if rows else np.zeros(0, np.int64)
    z, n = np.zeros((len(met), classes)), np.zeros((len(met), classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for idx, val, y in rows:
            at = np.searchsorted(met, idx)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(val @ w)
            p[y] -= 1
            g = val[:, None] * p[None, :]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    out = np.zeros((SIDE, classes), np.float32)
    out[met] = weights(z, n)
    return out


#: Natural logarithms of the temperatures that are searched.
COLDEST, HOTTEST = -8.0, 5.0


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm. As in Platt's scaling the rows are taken to be right one time less than always, 1 in n + 2, so the least loss is at a finite temperature even where all of them are."""
    n, k = logits.shape
    if k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), y] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    lo, hi, g = COLDEST, HOTTEST, 0.6180339887498949
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    t = (lo + hi) / 2
    if not COLDEST + 0.01 < t < HOTTEST - 0.01:
        raise RuntimeError(f"no temperature between exp({COLDEST}) and exp({HOTTEST}) fits")
    return float(np.exp(t))


def fit_language_id(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from text and non-null lang of the documents whose fold (crc32 of the id modulo 3) is not 1.

    Document frequencies count all of them: each task adds up its own and sends one row per bucket it met. The regression sees about `rows` of them for each language, chosen by hash (of rows that share id and language, the least text); their texts go to the driver as sparse vectors, a third of them set aside for the temperature. More than 1024 languages are an error; none is left out.
    """
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, mark = np.zeros(SIDE, np.int64), 0, np.zeros(SIDE, np.int64)
        worker_cache("")
        for batch in rebatched(batches):
            for t in texts(batch):
                mark[grams(t)] = 1
                df += mark
                mark[:] = 0
                n += 1
        met = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1).astype(np.int32)), pa.array(np.append(df[met], n))], ["bucket", "n"])

    found = learn.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # SIDE + 1 rows at most
    df, total = np.zeros(SIDE), 0
    for r in found:
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model([], idf, np.zeros((0, 0)))
        for batch in rebatched(batches, 200):
            got = [model.vector(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["doc_id", "lang", "idx", "val"])

    sample, _ = sampled_by_class(learn, "lang", "doc_id", rows)
    got = list(one_text_an_id(sample, "lang").mapInArrow(vectors, "doc_id long, lang string, idx binary, val binary").toLocalIterator())
    langs = sorted({r.lang for r in got})
    at = {x: i for i, x in enumerate(langs)}
    got.sort(key=lambda r: (crc32(f"order {r.doc_id}".encode()), r.doc_id, r.lang, bytes(r.idx)))
    data = [(np.frombuffer(bytes(r.idx), "<i4"), np.frombuffer(bytes(r.val), "<f4"), at[r.lang], crc32(f"aside {r.doc_id}".encode()) % 3 == 0) for r in got]
    if not data:
        return Model([], idf, np.zeros((SIDE, 0)))
    seen, aside = [d[:3] for d in data if not d[3]] or [d[:3] for d in data], [d[:3] for d in data if d[3]]
    w = ftrl(seen, len(langs))
    t = temperature(np.array([v @ w[i] for i, v, _ in aside]), np.array([y for _, _, y in aside])) if len(aside) > 1 else 1.0
    return Model(langs, idf, w, t)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; the text alone decides.

    A narrow pass. `und` with score 0: the text is null or empty or has no letter, or nothing was learned. Ties go to the language first by name. Other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIDE x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for batch in rebatched(batches):
            got = [sent.value.predict(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified_documents(docs: DataFrame, model: Model, accept_at: float = ACCEPT_AT) -> DataFrame:
    """The rows of docs, all columns, whose language is identified with a score of accept_at or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for batch in rebatched(batches):
            got = [sent.value.predict(t) for t in texts(batch)]
            yield batch.filter(pa.array([x != UNKNOWN and p >= accept_at for x, p in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
