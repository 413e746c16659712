"""Token counts under a unigram vocabulary: Aho-Corasick matches, and a Viterbi pass that carries the best score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rebatched, texts, worker_cache
from .pretokens import Memory, large_memory

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's memory of counted words.
WORDS = 1 << 20


def load_unigrams(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file without its control pieces; the unknown piece comes first."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    unk = model.unk_id()
    rest = [i for i in range(model.get_piece_size()) if i != unk and not model.is_control(i)]
    return [(model.id_to_piece(i), model.get_score(i)) for i in [unk, *rest]]


class Counter:
    """Counts the pieces of the best segmentation, as a unigram tokenizer with byte fallback makes it, without building it.

    Words start at spaces, with a mark for the space; a first word without one gets the mark. Ties: of the ways into a position, the one met first stays, that is the longest piece; a later one must score more. Where no one-character piece starts, the unknown piece competes at the lowest score less 10 and counts as its character's bytes.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in vocab:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.words = Memory(WORDS)

    def _word(self, word: str) -> int:
        n = len(word)
        ways: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.matches.iter(word):
            ways[end].append((length, score))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            top, pieces = None, 0
            for length, score in sorted(ways[e], key=lambda x: -x[0]):
                s = best[e + 1 - length] + score
                if top is None or s > top:
                    top, pieces = s, count[e + 1 - length] + 1
            if word[e] not in self.single:
                s = best[e] + self.unknown
                if top is None or s > top:
                    top, pieces = s, count[e] + len(word[e].encode("utf-8"))
            best[e + 1], count[e + 1] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        """The number of pieces of text; 0 for the empty text."""
        if not text:
            return 0
        head, *rest = text.replace(MARK, " ").split(" ")
        words, known = [*([head] if head else []), *rest], self.words.turn()
        try:
            return sum([known[x] for x in words])
        except KeyError:
            old = self.words.old
            for x in words:
                if x not in known:
                    known[x] = old.get(x) or self._word(MARK + x)
            return sum([known[x] for x in words])


def counter(path: str) -> Counter:
    kept = worker_cache("token counts")
    if path not in kept:
        large_memory()
        kept[path] = Counter(load_unigrams(path))
    return kept[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text, with the vocabulary and scores of the sentencepiece file at `path` read as unigrams.

    One narrow pass without a shuffle. Null and empty texts count 0; repeated rows give repeated results; other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in rebatched(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t) for t in texts(batch)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")
