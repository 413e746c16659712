"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import together, worker_cache
from .pretokens import Memory, chunks, laid_out, large_memory, marks, pretokens

#: Entries of a worker's memories of finished pieces and of merged pre-tokens.
PIECES, PRETOKENS = 1 << 18, 1 << 16
#: Texts, and bytes of them, that are encoded together.
TEXTS, BYTES = 500, 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PerfectHash:
    """A minimal perfect hash of the vocabulary (hash, displace): n keys fill n slots exactly.

    A key's 64-bit hash gives a bucket and two numbers; its bucket's displacement turns these into its slot. Buckets with several keys are placed first, largest first; single keys take the free slots directly (negative displacement). The slot stores key and rank, and a lookup compares the key, so foreign keys are told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.buckets = max(1, n // 3)
        self.seed = 0
        while not self._place(ranks):
            self.seed += 1

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        return (h >> 40) % self.buckets, (h & 0xFFFFF) % self.n, 1 + (h >> 20 & 0xFFFFF) % max(1, self.n - 1)

    def _place(self, ranks: dict[bytes, int]) -> bool:
        groups: dict[int, list] = {}
        for key in ranks:
            b, x, y = self._parts(key)
            groups.setdefault(b, []).append((x, y, key))
        self.shift = array("i", bytes(4 * self.buckets))
        self.keys: list[bytes | None] = [None] * self.n
        self.ids = array("i", bytes(4 * self.n))
        n, free = self.n, None
        for b, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) > 1:
                for d in range(1 << 16):
                    slots = [(x + d * y) % n for x, y, _ in members]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                else:
                    return False
                self.shift[b] = d
            else:
                free = free if free is not None else iter([s for s, k in enumerate(self.keys) if k is None])
                slots = [next(free)]
                self.shift[b] = -1 - slots[0]
            for s, (_, _, key) in zip(slots, members, strict=True):
                self.keys[s], self.ids[s] = key, ranks[key]
        return True

    def get(self, key: bytes) -> int | None:
        """The rank of key, None if it isn't in the vocabulary."""
        if not self.n:
            return None
        b, x, y = self._parts(key)
        d = self.shift[b]
        slot = -1 - d if d < 0 else (x + d * y) % self.n
        return self.ids[slot] if self.keys[slot] == key else None


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece by merges of lowest rank, leftmost first: a heap of pairs over a linked list of parts.

    A part is known by its first byte; a heap entry is rank x length + first byte, and counts only while that pair still has that rank.
    """
    n, get = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [get(piece[i : i + 2], -1) for i in range(n)]
    rank[n - 1] = -1
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if rank[i] != r:
            continue
        j = end[i]
        stop = end[i] = end[j]
        rank[j] = -1
        if stop < n:
            prev[stop] = i
            if (r := get(piece[i : end[stop]], -1)) >= 0:
                heapq.heappush(heap, r * n + i)
            rank[i] = r
        else:
            rank[i] = -1
        if i:
            h = prev[i]
            if (r := get(piece[h:stop], -1)) >= 0:
                heapq.heappush(heap, r * n + h)
            rank[h] = r
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def ranges(chars: set[str]) -> str:
    """The characters as ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


def as_tiktoken(pattern: str) -> regex.Pattern:
    """The pattern with the letters and numbers of the tiktoken library's Unicode version, which it is asked for."""
    import tiktoken

    blocks = ["".join(chr(i) for i in range(start, start + (1 << 14)) if not 0xD800 <= i < 0xE000) for start in range(0, 0x110000, 1 << 14)]
    for cls in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("classes", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = {c for block in blocks for c in bytes(library.encode_ordinary(block)).decode("utf-8")}
        ours = {c for block in blocks for c in regex.findall(cls, block)}
        exact = f"[{cls}--[{ranges(ours - theirs)}]]" if ours - theirs else cls
        exact = f"[{exact}||[{ranges(theirs - ours)}]]" if theirs - ours else exact
        pattern = pattern.replace(cls, exact)
    return regex.compile(pattern, regex.V1)


class Codec:
    """Encodes and decodes texts with a rank file. Ids are 32-bit, little-endian."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.table = PerfectHash(self.ranks)
        self.pattern = as_tiktoken(pattern)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.tokens = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)], pa.large_binary())
        self.pieces, self.pretokens = Memory(PIECES), Memory(PRETOKENS)

    def _pretoken(self, x: str) -> bytes:
        raw = x.encode("utf-8")
        rank = self.table.get(raw)
        if rank is not None:
            return struct.pack("<I", rank)
        ids = merged(raw, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        known, old = self.pretokens.turn(), self.pretokens.old
        out = []
        for x in pretokens(piece, self.pattern.findall):
            got = known.get(x)
            if got is None:
                got = known[x] = old.get(x) or self._pretoken(x)
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def _packed(self, found: list[str]) -> list[bytes]:
        """The ids of each piece."""
        known, old = self.pieces.turn(), self.pieces.old
        got = list(map(known.get, found))
        if None in got:
            for i, packed in enumerate(got):
                if packed is None:
                    x = found[i]
                    if (packed := known.get(x)) is None:
                        packed = known[x] = old.get(x) or self._piece(x) if x else b""
                    got[i] = packed
        return got

    def encode(self, text: str) -> bytes:
        """The ids of text, packed; the empty text has none."""
        return b"".join(self._packed(chunks(text)))

    def encode_batch(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each begins and the last ends."""
        marked = marks(batch)
        ids, at = laid_out(marked, self._packed, np.dtype("<u4"))
        odd = np.flatnonzero(marked.is_null().to_numpy(zero_copy_only=False)).tolist()
        if not odd:
            return ids, at
        own = {i: np.frombuffer(self.encode(batch[i].as_py()), "<u4") for i in odd}
        parts = [own[i] if i in own else ids[at[i] : at[i + 1]] for i in range(len(batch))]
        return np.concatenate([np.zeros(0, np.dtype("<u4")), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def decode_batch(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that ids stand for, one after the other, and where each id's begin and the last's end. KeyError: an id isn't in the vocabulary."""
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise KeyError(int(ids.max()))
        raw = self.tokens.take(pa.array(ids))
        if raw.null_count:
            raise KeyError("an id that stands for nothing")
        _, offsets, data = raw.buffers()
        return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for. KeyError: an id isn't in the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """This worker's codec for a rank file."""
    kept = worker_cache("bpe")
    if (path, pattern) not in kept:
        large_memory()
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, with_ids, ids as packed 32-bit integers and the decoded text) of every whole text.

    One narrow pass: no shuffle; memory is one Arrow batch and the worker's bounded memory of pieces. Null texts count as empty: no ids, digests of no bytes. Repeated rows give repeated results; other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for names, batch in together(batches, TEXTS, BYTES):
            ids, at = c.encode_batch(batch)
            raw, ends = c.decode_batch(ids)
            packed = memoryview(np.ascontiguousarray(ids)).cast("B")
            spans = list(zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True))
            cols = [names, pa.array(np.diff(at)), pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b, _, _ in spans]), pa.array([hashlib.sha256(raw[c:d]).hexdigest() for _, _, c, d in spans])]
            if with_ids:
                cols += [pa.array([bytes(packed[a:b]) for a, b, _, _ in spans], pa.binary()), pa.array([bytes(raw[c:d]).decode("utf-8") for _, _, c, d in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
