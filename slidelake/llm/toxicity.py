"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other. Five small transducers, each reading what the one before it writes, mark each insult or threat of a clause as plain, aimed at someone, negated or reported; their composition is built state by state as it is needed. A logistic curve over the weights of the marked matches, fitted on labelled rows, gives the score. Insult stems are seed words and stems that the labelled rows teach; insults and threats weigh what the labels say.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, one_text_an_id, rebatched, sampled_by_class, texts, worker_cache, written

# Seed words of the grammar, in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool imbecile bastard filth dumb ugly dummkopf trottel abschaum arschloch wertlos crétin imbécile salaud ordure idiota estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy beat stab shoot punish crush töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself he him his she her they them their people du dich dein sie euch ihr tu te toi vous votre ils tú usted ustedes te ti ellos".split()
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says say reported reports claimed wrote called quoted allegedly sagte sagt berichtete dit écrit rapporté dijo dice escribió informó".split()
# End of the seed words.

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds of marked matches, in order of the features.
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")
NEGATION_REACH, TARGET_REACH = 3, 4  # words
#: The grammar is fitted on about this many labelled rows of each class at most.
FIT_ROWS = 1500
STEM_LENGTHS = range(4, 9)
MEMORY = 1 << 20

_CLAUSE_END = re.compile(r"[.!?;:,\n]$")
_EDGE = re.compile(r"^\W+|\W+$")


#: Marks that transducers write on a word.
HIT, AIMED, NEGATED, REPORTED = 1, 2, 4, 8
Label = tuple[int, int]  # a word's symbol and its marks


class Acceptor:
    """A transducer of one state that marks the words of a symbol as matches."""

    start = 0

    def __init__(self, symbol: int):
        self.symbol = symbol

    def step(self, state: int, label: Label) -> tuple[int, Label]:
        symbol, marks = label
        return state, (symbol, marks | HIT if symbol == self.symbol else marks)


class Near:
    """A transducer that marks the matches up to `reach` words behind one of its symbols (None: to the clause's end). State: words left."""

    start = 0

    def __init__(self, symbol: int, mark: int, reach: int | None):
        self.symbol, self.mark, self.reach = symbol, mark, reach

    def step(self, state: int, label: Label) -> tuple[int, Label]:
        symbol, marks = label
        out = (symbol, marks | self.mark if state and marks & HIT else marks)
        if symbol == self.symbol:
            return self.reach or 1, out
        return state if self.reach is None else max(0, state - 1), out


class Composition:
    """Transducers in a row, each one reading what the one before it writes. A state is the tuple of theirs; a transition is made when first taken and remembered."""

    def __init__(self, *parts: Acceptor | Near):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.table: dict[tuple[tuple[int, ...], Label], tuple[tuple[int, ...], Label]] = {}

    def move(self, state: tuple[int, ...], label: Label) -> tuple[tuple[int, ...], Label]:
        got = self.table.get((state, label))
        if got is None:
            states, out = [], label
            for p, s in zip(self.parts, state, strict=True):
                s, out = p.step(s, out)
                states.append(s)
            got = self.table[state, label] = tuple(states), out
        return got

    def read(self, labels: list[Label]) -> list[Label]:
        state, out = self.start, []
        for x in labels:
            state, y = self.move(state, x)
            out.append(y)
        return out


class Grammar:
    """Insult, threat, negation, reported speech and target in one composition, read from left to right; the target transducer once more from right to left, for targets behind a match."""

    def __init__(self) -> None:
        target = Near(TARGET, AIMED, TARGET_REACH)
        self.forth = Composition(Acceptor(INSULT), Acceptor(THREAT), Near(NEGATION, NEGATED, NEGATION_REACH), Near(REPORT, REPORTED, None), target)
        self.back = Composition(target)

    def matches(self, symbols: list[int]) -> list[int]:
        """The kind of each position of a clause; -1: no match. Negation goes before reported speech, and that before the target."""
        labels = self.back.read(self.forth.read([(s, 0) for s in symbols])[::-1])[::-1]
        return [-1 if not m & HIT else (2 if m & NEGATED else 3 if m & REPORTED else 1 if m & AIMED else 0) + (4 if s == THREAT else 0) for s, m in labels]


@dataclass
class Model:
    """stems: weight of words that begin so; whole: weight of whole words, insults but for the threats; coef and bias of the features."""

    stems: dict[str, float]
    whole: dict[str, float]
    coef: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(KINDS)))
    bias: float = -2.0

    def __post_init__(self) -> None:
        self.symbols = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.insults = {w: x for w, x in self.whole.items() if w not in self.symbols}
        self.known: dict[str, tuple[int, float, bool]] = {}
        self.grammar = Grammar()

    def read(self, token: str) -> tuple[int, float, bool]:
        """Symbol, weight and whether the clause ends behind the token."""
        word = _EDGE.sub("", token).lower()
        weight = max([self.insults.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEM_LENGTHS if len(word) >= k)])
        symbol = INSULT if weight > 0 else self.symbols.get(word, OTHER)
        return symbol, weight if symbol == INSULT else self.whole.get(word, 1.0), bool(_CLAUSE_END.search(token))

    def features(self, text: str) -> np.ndarray:
        """Of each kind: the largest weight, and the logarithm of 1 + the sum of weights."""
        known, tokens = self.known, text.split()
        for t in set(tokens).difference(known):
            if len(known) >= MEMORY:
                known.clear()
            known[t] = self.read(t)
        read = [known.get(t) or self.read(t) for t in tokens]
        top, total = np.zeros(len(KINDS)), np.zeros(len(KINDS))
        if any(s in (INSULT, THREAT) for s, _, _ in read):
            begin = 0
            for i, (_, _, ends) in enumerate(read):
                if ends or i == len(read) - 1:
                    clause = read[begin : i + 1]
                    if any(s in (INSULT, THREAT) for s, _, _ in clause):
                        for k, (_, w, _) in zip(self.grammar.matches([c[0] for c in clause]), clause, strict=True):
                            if k >= 0:
                                top[k], total[k] = max(top[k], w), total[k] + w
                    begin = i + 1
        return np.concatenate([top, np.log1p(total)])

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-35.0, min(35.0, float(self.features(text) @ self.coef) + self.bias)))))

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "whole": self.whole, "coef": self.coef, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)


def learned_stems(toxic: list[set[str]], clean: list[set[str]], least: int = 4, ratio: float = 20.0) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and whole words that toxic documents have and others hardly have, and what the seed words weigh.

    A candidate must pass in both halves of the documents, so chance finds and label noise teach nothing; documents that share much the same rarer words fall in the same half. A greedy cover: each step takes the candidate that explains most toxic documents which nothing chosen explains yet, so the rest of a document that an insult explains teaches nothing. Ties go to the longer stem, then by spelling. Weights are smoothed log odds.
    """
    seeds = set(INSULTS)

    def candidates(words: set[str]) -> set[str]:
        return {f"{w}$" for w in words if len(w) >= 3} | {w[:k] for w in words for k in STEM_LENGTHS if len(w) > k}

    def odds(t: int, c: int, toxic: int, clean: int) -> float:
        return math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))

    common = Counter(w for words in (*toxic, *clean) for w in words)
    half = lambda words: min((crc32(w.encode()) for w in words if 10 * common[w] < len(toxic) + len(clean)), default=0) & 1
    left = [w for w in toxic if not w & seeds]
    halves, other = [half(w) for w in left], [half(w) for w in clean]
    met: tuple[Counter, Counter] = (Counter(), Counter())
    for words, h in zip(left, halves, strict=True):
        met[h].update(candidates(words))
    chosen = {c for c in met[0] if min(met[0][c], met[1][c]) * 2 >= least}
    against: tuple[Counter, Counter] = (Counter(), Counter())
    for words, h in zip(clean, other, strict=True):
        against[h].update(candidates(words) & chosen)
    chosen = {c for c in chosen if all(odds(met[h][c], against[h][c], halves.count(h), other.count(h)) >= math.log(ratio) for h in (0, 1))}
    holds: dict[str, set[int]] = {}
    for i, words in enumerate(left):
        for c in candidates(words) & chosen:
            holds.setdefault(c, set()).add(i)
    stems, whole, open_ = {}, {}, set(range(len(left)))
    while holds:
        no = lambda c: against[0][c] + against[1][c]
        best = max(holds, key=lambda c: (len(holds[c] & open_) - 2 * no(c), len(c), c))
        if len(holds[best] & open_) - 2 * no(best) < least:
            break
        (whole if best.endswith("$") else stems)[best.rstrip("$")] = odds(len(holds[best]), no(best), len(toxic), len(clean))
        open_ -= holds.pop(best)
    for w in (*INSULTS, *THREATS):
        t, c = sum(w in x for x in toxic), sum(w in x for x in clean)
        whole[w] = max(odds(t, c, len(toxic), len(clean)), 0.05) if t + c else 1.0
    return stems, whole


#: Coefficients before any label is seen, of KINDS.
PRIOR = (1.0, 1.5, 0.2, 0.2, 0.5, 1.5, 0.1, 0.1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from about `rows` labelled documents of either class whose fold (crc32 of the id modulo 5) is not 0, chosen by hash. Of rows that share an id the least text counts. Their distinct words, then their features, go to the driver."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")).where(fold("doc_id", 5) != 0)
    sample, _ = sampled_by_class(known, "y", "doc_id", rows)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # 2 x rows at most, about
    learn = written(one_text_an_id(learn, "y").select("y", "text"), "learn")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 200):
            got = [" ".join(sorted({_EDGE.sub("", w).lower() for w in t.split()} - {""})) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["y", "words"])

    bags = [(r.y, set(r.words.split())) for r in learn.mapInArrow(words, "y int, words string").toLocalIterator()]
    model = Model(*learned_stems([b for y, b in bags if y], [b for y, b in bags if not y]))
    plain = (model.stems, model.whole)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*plain)
        for batch in rebatched(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.features(t).tolist() for t in texts(batch)], pa.list_(pa.float64()))], ["y", "x"])

    data = sorted((r.y, r.x) for r in learn.mapInArrow(featured, "y int, x array<double>").collect())
    discard(learn)
    y, x = np.array([d[0] for d in data], float), np.array([d[1] for d in data], float)
    if len(set(y)) < 2:
        model.coef = np.array(PRIOR * 2)
        return model
    model.coef, model.bias = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge; both classes weigh the same. The ridge draws towards PRIOR, which is what kinds that no row shows keep."""
    a = np.column_stack([x, np.ones(len(y))])
    prior = np.append(np.array(PRIOR * 2), -2.0)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = prior.copy()
    ridge = np.append(np.full(x.shape[1], l2), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * (w - prior))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; the text alone decides.

    A narrow pass. Null and empty texts have no clause and get the curve at its bias alone. Other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for batch in rebatched(batches):
            p = [sent.value.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array([int(s >= 0.5) for s in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
