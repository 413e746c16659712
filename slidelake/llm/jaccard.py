"""N-gram Jaccard join by set-relation skipping.

Sets are the distinct word shingles of the texts. Rare shingles come first in every set, and a set is indexed by a prefix that no partner can miss. Two relations between sets save work. Within a list, entries stand in blocks ordered by size, each with its least position, so a block that cannot reach the threshold is skipped as one. Across sets, answers are derived: sets that must be compared with many others meet in a task, which walks from set to set along the smallest differences; a set's overlaps with all others are its predecessor's, less those of the shingles that went, plus those of the shingles that came.

What the lists leave open goes as pairs where they are few, past a bitmap that bounds the overlap from above, and as groups of sets where a list is dense, so no list gives all its pairs as rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, give_back, rebatched, semi_by_id, texts, worker_cache, written
from .graph import connected_components

WORDS, PERCENT = 5, 75
#: The order of shingles comes from two tables of counters that all shingles of the corpus are added to; the smaller of a shingle's two counters is its frequency. The order changes the work, never the result.
COUNTERS, SEGMENTS = 1 << 21, 64
#: Shingles that a slab's sets share so often, and how many of the most frequent of them, are dealt out by set as well.
HOT_IN_SLAB, HOT = 16, 1 << 16
#: Shingles that are worked on together in a task.
SLAB = 500_000
#: Postings of a bucket, about; postings of a hot shingle that a part takes; entries of a block.
BUCKET, CHUNK, BLOCK = 250_000, 20_000, 16
#: A list that leaves more pairs open than this for each of its sets goes as a group.
DENSE = 4
#: Shingles of the sets that a side of a task holds, about (8 B each).
SIDE = 2_000_000
#: Rows of the table of sets that are compared up to which it is broadcast, 60 B each at most.
WANTED = 1 << 20
#: Bits of a bitmap, at most.
BITS = 1 << 15
NO_ID = -(1 << 63)  # stands for a doc_id that is null

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct k-word shingles of text, A-Z in lower case. Fewer words: one for the whole sequence; no word: none."""
    words = text.encode("utf-8").lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _MUL[i % 5] + np.uint64(i // 5)
    h ^= h >> np.uint64(29)
    h *= _MUL[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def set_id(s: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit number for a set; equal sets share it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed)).astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each bit, about a bit a shingle. Two bitmaps differ in no more bits than their sets in shingles."""
    width = min(BITS, max(64, 1 << (len(s) - 1).bit_length()))
    at = (s * _MUL[3] >> np.uint64(49)).astype(np.int64) & (width - 1)
    return np.packbits(np.bincount(at, minlength=width) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """How many bits of two bitmaps differ, the wider one folded."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def probe_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix that meets any partner's: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def index_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix that meets any partner of the same size or larger: n - ceil(2 t / (1 + t) n) + 1."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _slabs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of documents, SLAB shingles at a time."""
    worker_cache("")
    ids, sets, total = [], [], 0
    for batch in rebatched(batches):
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            s = shingles(t, k)
            ids.append(i)
            sets.append(s)
            total += len(s)
            if total >= SLAB:
                yield ids, sets
                ids, sets, total = [], [], 0
    if ids:
        yield ids, sets


def counters(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of shingles in the two tables."""
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    return (s * _MUL[0] >> shift).astype(np.int64), (s * _MUL[1] >> shift).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    kind = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 8
    return bytes([kind]) + zlib.compress(counts.astype(f"<u{kind}").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}")


def described(docs: DataFrame, k: int = WORDS, seed: int = 0) -> DataFrame:
    """A row for each document: doc_id, n, cls (set_id; null for the empty set), twin (a second digest) and bits (bitmap). Rows with token and count: shingles that many sets of a slab share. Rows with segment and payload: a task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, COUNTERS), np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("twin", pa.int64()), ("bits", pa.binary()), ("token", pa.int64()), ("count", pa.int64()), ("segment", pa.int32()), ("payload", pa.binary())])
        row = lambda length, **cols: pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(length, f.type) for f in schema], schema=schema)
        for ids, sets in _slabs(batches, k):
            cls = [set_id(s, seed) if len(s) else None for s in sets]
            yield row(len(ids), doc_id=ids, n=list(map(len, sets)), cls=cls, twin=[set_id(s, ~seed & 0xFFFFFFFF) if len(s) else None for s in sets], bits=[bitmap(s) if len(s) else None for s in sets])
            once = list({c: s for c, s in zip(cls, sets, strict=True) if c is not None}.values())
            if once:
                every = np.concatenate(once)
                for table, places in zip(tables, counters(every), strict=True):
                    table += np.bincount(places, minlength=COUNTERS).astype(np.uint32)
                every.sort()
                # Positions at which a run of HOT_IN_SLAB equal shingles begins.
                far = every[HOT_IN_SLAB - 1 :] == every[: len(every) - HOT_IN_SLAB + 1] if len(every) >= HOT_IN_SLAB else np.zeros(0, bool)
                token = np.unique(every[: len(far)][far])
                if len(token):
                    count = np.searchsorted(every, token, "right") - np.searchsorted(every, token)
                    yield row(len(token), token=token.view(np.int64), count=count)
        if tables.any():
            cut = tables.reshape(2 * SEGMENTS, -1)
            yield row(len(cut), segment=list(range(len(cut))), payload=[_packed(c) for c in cut])

    return docs.mapInArrow(run, "doc_id long, n long, cls long, twin long, bits binary, token long, count long, segment int, payload binary")


def frequencies(seen: DataFrame) -> np.ndarray:
    """The two tables summed over all tasks: the logarithm of each counter in 16 bits. Each task adds up the segments it is dealt, batch by batch; the driver receives 2 x COUNTERS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + _unpacked(raw).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.round(np.log1p(c) * 1500).astype("<u2").tobytes() for c in total.values()], pa.binary())], ["segment", "payload"])

    out = np.zeros((2 * SEGMENTS, COUNTERS // SEGMENTS), np.uint16)
    for r in seen.where("segment is not null").select("segment", "payload").repartition("segment").mapInArrow(run, "segment int, payload binary").toLocalIterator():
        out[r.segment] = np.frombuffer(r.payload, "<u2")
    return out.reshape(2, COUNTERS)


def ordered(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The set, rare shingles first; ties by hash."""
    a, b = counters(s)
    return s[np.argsort(np.minimum(known[0][a], known[1][b]), kind="stable")]


def postings(docs: DataFrame, known: np.ndarray, hot: np.ndarray, parts: np.ndarray, buckets: int, k: int, percent: int, seed: int = 0) -> DataFrame:
    """Packed prefixes: for each slab and bucket one row with the tokens, sets, sizes and positions of its postings.

    The postings of a hot shingle are dealt out by set to its parts, so no bucket holds them all. Equal sets of a slab send theirs once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, hot, parts))  # 8 MB and 16 B x HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot, parts = sent.value
        for _, sets in _slabs(batches, k):
            once = {set_id(s, seed): s for s in sets if len(s)}
            if not once:
                continue
            size = np.array([len(s) for s in once.values()], np.int64)
            take = probe_prefix(size, percent)
            token = np.concatenate([ordered(s, known)[:p] for s, p in zip(once.values(), take.tolist(), strict=True)])
            cls, sizes = np.repeat(np.array(list(once), np.int64), take), np.repeat(size, take).astype(np.int32)
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(take) - take, take)).astype(np.int32)
            salt = np.zeros(len(token), np.uint64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                salt = cls.view(np.uint64) % np.where(hot[at] == token, parts[at], 1).astype(np.uint64)
            bucket = ((token + salt * _MUL[2]) * _MUL[0] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            met, begin = np.unique(bucket[order], return_index=True)
            ends = np.append(begin[1:], len(order))
            cut = [order[a:b] for a, b in zip(begin, ends, strict=True)]
            for i in range(0, len(met), 64):
                yield pa.RecordBatch.from_arrays([pa.array(met[i : i + 64].astype(np.int32)), *[pa.array([x[c].tobytes() for c in cut[i : i + 64]], pa.binary()) for x in (token, cls, sizes, pos)]], ["bucket", "token", "cls", "size", "pos"])

    return docs.mapInArrow(run, "bucket int, token binary, cls binary, size binary, pos binary")


def lists_of(table: pa.Table, hot: np.ndarray, percent: int) -> pa.Table:
    """What a bucket's lists leave open: pairs (a, b) of sets, and the members (g, cls, size) of groups in which every pair is to be compared.

    A list is a group if it is dense (g is its least set, so lists with much the same sets give one group) or a part of a hot shingle's (g is the shingle).
    """
    col = lambda n, t: np.frombuffer(b"".join(table.column(n).to_pylist()), t)
    token, cls, size, pos = col("token", np.uint64), col("cls", np.int64), col("size", np.int32), col("pos", np.int32)
    order = np.lexsort((cls, size, token))
    token, cls, size, pos = token[order], cls[order], size[order], pos[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])  # equal sets of other slabs
    token, cls, size, pos = token[new], cls[new], size[new], pos[new]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(token))[: len(begin)]
    is_hot = np.isin(token[begin], hot)
    stop = np.repeat(np.where(is_hot | (end - begin > BLOCK), 0, end), end - begin)
    pairs, members = [], []
    for d in range(1, BLOCK):  # lists of one block: entries d apart
        i = np.flatnonzero(np.arange(len(token)) + d < stop)
        i = i[possible(size[i], pos[i], size[i + d], pos[i + d], percent)]
        pairs.append((i, i + d))
    for a, b, whole in zip(*(x[is_hot | (end - begin > BLOCK)].tolist() for x in (begin, end, is_hot)), strict=True):
        met, found = 0, []
        if not whole:
            for x, y in list_pairs(size[a:b], pos[a:b], percent):
                found.append((x + a, y + a))
                met += len(x)
                if met > DENSE * (b - a):
                    whole = True
                    break
        if whole:
            members.append((np.full(b - a, token[a : a + 1].view(np.int64)[0] if np.isin(token[a], hot) else cls[a:b].min()), cls[a:b], size[a:b]))
        else:
            pairs += found
    none = np.zeros(0, np.int64)
    x, y = (np.concatenate([none, *(p[i] for p in pairs)]) for i in (0, 1))
    u, v = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    g, c, n = (np.concatenate([none, *(x[i] for x in members)]).astype(np.int64) for i in range(3))
    order = np.lexsort((c, g))
    g, c, n = g[order], c[order], n[order]
    once = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))[: len(g)]
    u, v, g, c, n = u[first], v[first], g[once], c[once], n[once]
    give_back()
    return pa.table({"a": pa.array(np.append(u, g)), "b": pa.array(np.append(v, c)), "n": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(n)])})


def possible(sx: np.ndarray, px: np.ndarray, sy: np.ndarray, py: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets x and y, x not larger, with a common shingle at these positions may reach the threshold: sizes allow it, the shingle is in x's index prefix, and what is left of both suffices."""
    sx, sy, px, py = (v.astype(np.int64) for v in (sx, sy, px, py))
    need = -(-percent * (sx + sy) // (100 + percent))
    return (sx * 100 >= sy * percent) & (px < index_prefix(sx, percent)) & (np.minimum(px, py) + np.minimum(sx - px, sy - py) >= need)


def list_pairs(size: np.ndarray, pos: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller, larger) of a list's entries, sorted by size, that may link.

    Entries stand in blocks. A block and the entries no smaller than its first are compared only if the block's largest size and least position leave that open.
    """
    n = len(size)
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK)
        j = np.arange(s, np.searchsorted(size, size[e - 1] * 100 // percent, "right"))
        need = -(-percent * (size[s].astype(np.int64) + size[j]) // (100 + percent))
        least = int(pos[s:e].min())
        j = j[np.minimum(least, pos[j]) + np.minimum(int(size[e - 1]) - least, size[j] - pos[j]) >= need]  # the block's best case
        if not len(j):
            continue
        i = np.arange(s, e)
        x, y = np.nonzero(i[:, None] < j[None, :])
        x, y = i[x], j[y]
        good = possible(size[x], pos[x], size[y], pos[y], percent)
        yield x[good], y[good]


def linked_in_group(cls: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links of a spanning forest among a group's sets (or every link, once), every pair of different sides (or any, if there is one) considered.

    The overlaps of the first set with all others are counted through an inverted index. The next set is the one that differs least from the last; its overlaps are derived from the last one's through the lists of the shingles in which the two differ, if these are fewer than its own. Of two sides only the smaller one's sets are walked.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), size)
    shared = np.bincount(token)[token] > 1  # the others meet nothing
    token, owner = token[shared], owner[shared]
    own = np.split(token, np.cumsum(np.bincount(owner, minlength=m))[:-1])
    length = np.bincount(token, minlength=1)
    begin = np.cumsum(length) - length
    owner = owner[np.argsort(token, kind="stable")]

    def met(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        n = length[tokens]
        return np.bincount(owner[np.repeat(begin[tokens] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)

    sides = np.unique(side, return_counts=True)
    left = side == sides[0][sides[1].argmin()] if len(sides[0]) > 1 else np.ones(m, bool)
    small = np.array([len(t) for t in own], np.int64)
    tree, out = np.arange(m), []
    at, common = -1, np.zeros(m, np.int64)
    for _ in range(int(left.sum())):
        if at < 0:
            z, gap = int(left.argmax()), np.inf
        else:
            gaps = np.where(left, small[at] + small - 2 * common, np.iinfo(np.int64).max)
            z = int(gaps.argmin())
            gap = gaps[z]
        if gap < small[z]:
            common = common + met(np.setdiff1d(own[z], own[at], assume_unique=True)) - met(np.setdiff1d(own[at], own[z], assume_unique=True))
        else:
            common = met(own[z])
        at, left[z] = z, False
        good = 100 * common >= percent * (size[z] + size - common)
        if len(sides[0]) > 1:
            good &= side != side[z]
        if every:
            good[z] = False
            good &= left if len(sides[0]) < 2 else True
            out += [(int(cls[z]), int(cls[j])) for j in np.flatnonzero(good)]
            continue
        good &= tree != tree[z]
        if good.any():
            others = np.flatnonzero(good)
            trees, first = np.unique(tree[others], return_index=True)
            out += [(int(cls[z]), int(cls[j])) for j in others[first]]
            tree[np.isin(tree, trees)] = tree[z]
    return out


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave the threshold open, with b's size n."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [x + y for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            apart = list(map(least_difference, batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            # The overlap is (total - difference) / 2, so 100 o >= percent (total - o) is (100 + percent) (total - difference) >= 2 percent total.
            open_ = [(100 + percent) * (t - d) >= 2 * percent * t for t, d in zip(total, apart, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], ["a", "b", "n"]).filter(pa.array(open_, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long, n long")


def star_tasks(near: DataFrame) -> DataFrame:
    """(cls, task) for pairs (a, b): a against the bs of a part, whose sets hold about SIDE shingles."""
    parts = near.groupBy("a").agg((F.floor(F.sum("n") / SIDE) + 1).cast("int").alias("parts"))
    task = lambda p, side: F.struct(F.col("a").alias("g"), F.lit(-1).alias("c"), p.alias("p"), F.lit(0).alias("q"), F.lit(side).alias("side"))
    spokes = near.join(parts, "a").select(F.col("b").alias("cls"), task(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), 1).alias("task"))
    hubs = parts.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("a").alias("cls"), task(F.col("p"), 0).alias("task"))
    return spokes.unionByName(hubs)


def group_tasks(members: DataFrame, percent: int) -> DataFrame:
    """(cls, task) for the members (g, cls, n) of groups. A group whose sets hold more than SIDE shingles is cut: by size, so that only neighbouring classes can link, and within a class by set. A task holds one part, two of a class, or one each of neighbouring classes."""
    step = 1.0001 * math.log(100 / percent)
    rows = members.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    sums = rows.groupBy("g", "k").agg(F.sum("n").alias("n"))
    groups = sums.groupBy("g").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("k", (F.floor(F.col("n") / SIDE) + 1).cast("int")))).alias("parts"))  # a few dozen classes
    groups = groups.select("g", (F.col("all") > SIDE).alias("cut"), F.when(F.col("all") > SIDE, F.col("parts")).otherwise(F.create_map(F.lit(0), F.lit(1))).alias("parts"))
    rows = rows.join(groups, "g").withColumn("k", F.when(F.col("cut"), F.col("k")).otherwise(0))
    parts = lambda k: F.try_element_at("parts", k)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), parts(F.col("k"))).cast("int"))
    # c is twice the class for tasks within it, one more for those with the next class.
    task = lambda c, p, q, side: F.struct(F.col("g").alias("g"), c.cast("int").alias("c"), p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    every = lambda n, made: F.when(n.isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), n - 1), made))
    k, own = F.col("k"), F.col("own")
    within = every(parts(k), lambda y: task(2 * k, F.least(own, y), F.greatest(own, y), own))
    above = every(parts(k + 1), lambda y: task(2 * k + 1, own, y, F.lit(0)))
    below = every(parts(k - 1), lambda y: task(2 * k - 1, y, own, F.lit(1)))
    return rows.select("cls", F.explode(F.concat(within, above, below)).alias("task"))


def linked(tasks: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, seed: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) that the tasks (cls, task) find; unless `every` one is wanted, some among sets that others join already are left out. Texts are read again for the sets that have a task, one document each; a set goes to each of its tasks once. Also returns the table of the sets' tasks, which can go when the links are written."""
    wanted = written(tasks.groupBy("cls").agg(F.collect_set("task").alias("tasks")).join(classes.select("cls", "rep"), "cls"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 200):
            got = [s for s in (shingles(t, k) for t in texts(batch)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s, seed) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["cls", "s"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cls, first = np.unique(table.column("cls").to_numpy(), return_index=True)  # repeated rows
        table = table.take(first)
        found = linked_in_group(cls, [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()], table.column("side").to_numpy(), percent, every)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "text")
    made = semi_by_id(keyed, wanted.select("rep").distinct(), "rep").mapInArrow(sets, "cls long, s binary")
    few = (wanted.agg(F.sum(F.size("tasks"))).first()[0] or 0) <= WANTED
    dealt = made.join(F.broadcast(wanted) if few else wanted, "cls").select("cls", "s", F.explode("tasks").alias("t")).select("t.*", "cls", "s")
    return dealt.groupBy("g", "c", "p", "q").applyInArrow(run, "a long, b long"), wanted


def _joined(docs: DataFrame, k: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, int, list[DataFrame]]:
    """Documents (doc_id, n, cls), the classes of equal sets (cls, rep, n), links (a, b) between classes, the seed of the set ids, and tables that can go when the links are written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for seed in range(8):
        seen = written(described(rows, k, seed), "described")
        found = seen.where("cls is not null").groupBy("cls").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("twin").alias("twin"), F.max("twin").alias("other"))
        classes = written(found, "classes")
        if not classes.where("twin <> other").limit(1).count():
            break  # else different sets share a number, which another seed tells apart
    else:
        raise RuntimeError("different sets share their numbers")
    hottest = seen.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= CHUNK).orderBy(F.desc("count"), "token").limit(HOT).collect()
    hot = np.array(sorted((r.token, r["count"]) for r in hottest), np.int64).reshape(-1, 2)
    hot = hot[np.argsort(hot[:, 0].view(np.uint64))]
    tokens, parts = np.ascontiguousarray(hot[:, 0]).view(np.uint64), hot[:, 1] // CHUNK + 1
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total * (100 - percent) / 100 / BUCKET) + 1)
    packed = postings(rows, frequencies(seen), tokens, parts, buckets, k, percent, seed)
    open_ = written(packed.groupBy("bucket").applyInArrow(lambda table: lists_of(table, tokens, percent), "a long, b long, n long"), "open")
    near = written(near_pairs(open_.where("n is null").select("a", "b").distinct(), classes, percent), "near")
    members = open_.where("n is not null").select(F.col("a").alias("g"), F.col("b").alias("cls"), "n").distinct()
    links, wanted = linked(star_tasks(near).unionByName(group_tasks(members, percent)), rows, classes, k, percent, seed, every)
    return seen.where("token is null and segment is null").select("doc_id", "n", "cls"), classes, links, seed, [open_, near, wanted]


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, int]:
    """Documents (doc_id, n, cls), the classes of equal sets (cls, root, rep) with each one's component (root, a set id) and smallest doc_id (NO_ID: none), and the seed of the set ids."""
    each, classes, links, seed, used = _joined(docs, k, percent, False)
    links = written(links, "links")  # on its own, so that no task has two workers
    known = connected_components(links)
    discard(links, *used)
    return each, classes.join(known, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("root"), "rep"), seed


def jaccard_links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: every link (a, b, a < b) between different sets, each once, by the smallest doc_id that has the set; and the membership (doc_id, rep) of documents in sets.

    Documents without words are in no set; sets that only rows without doc_id have are left out of the links. As many rows as there are links, so not for corpora of large near-duplicate groups, where jaccard_components says who belongs together.
    """
    each, classes, links, _, used = _joined(docs, k, percent, True)
    links = written(links, "links")
    discard(*used)
    id_of = lambda c: classes.where(F.col("rep") != NO_ID).select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"))
    pairs = links.join(id_of("a"), "a").join(id_of("b"), "b").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    return pairs, each.where("cls is not null and doc_id is not null").join(classes.select("cls", "rep"), "cls").select("doc_id", "rep")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: two link when 100 x intersection >= percent x union of their sets; component_id is the smallest doc_id reachable by links.

    Equal sets are one class. Documents without words (null, empty or white texts) have n_shingles 0 and link with nothing. Repeated rows are documents of a class. Where a doc_id is null, the component is the smallest id that its text reaches, null if there is none. Other columns of docs are ignored. Shingles are compared by 64-bit hashes, sets told apart by 128 bits. The answer is the component: links between sets that others join already need not be found; jaccard_links returns links.
    """
    each, table, _ = components(docs, k, percent)
    least = table.groupBy("root").agg(F.min(F.when(F.col("rep") != NO_ID, F.col("rep"))).alias("least"))
    table = table.join(least, "root").select(F.col("cls").alias("c"), "least")
    out = each.join(table, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: of its rows one with the smallest doc_id (of several sets under that id, the one with the least number; of repeated rows, one). Rows without doc_id stay, and so do rows without words (of those that share a doc_id, one).

    Rows that share their doc_id with no other row are kept or dropped where they lie; only the others' texts are shuffled.
    """
    each, table, seed = components(docs, k, percent)
    least = table.where(F.col("rep") != NO_ID).groupBy("root").agg(F.min(F.struct("rep", "cls")).alias("least")).select("least.*")
    least = written(least, "kept")
    empty = each.where("cls is null and doc_id is not null").select(F.col("doc_id").alias("rep"), F.lit(None).cast("long").alias("cls"))
    repeated = written(each.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "repeated")
    got = docs.withColumn("__id", F.col("doc_id").cast("long"))
    ids = least.unionByName(empty).select(F.col("rep").alias("__id")).distinct().join(repeated, "__id", "left_anti")
    out = semi_by_id(got, written(ids, "ids"), "__id").unionByName(got.where("__id is null"))
    if repeated.limit(1).count():
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rebatched(batches, 200):
                got = [shingles(t, k) for t in texts(batch, "__text")]
                ids = pa.array([set_id(s, seed) if len(s) else None for s in got], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "__cls"])

        some = semi_by_id(got, repeated, "__id").select(*got.columns).withColumn("__text", F.col("text").cast("string"))
        some = some.mapInArrow(sets, StructType([*got.schema.fields, StructField("__cls", LongType())]))
        white = some.where("__cls is null").drop("__cls").dropDuplicates(["__id"])
        least = least.select(F.col("rep").alias("__rep"), F.col("cls").alias("__least"))
        some = some.join(least, (F.col("__id") == F.col("__rep")) & (F.col("__cls") == F.col("__least"))).dropDuplicates(["__id", "__cls"]).select(*got.columns)
        out = out.unionByName(some).unionByName(white)
    return out.drop("__id")


#: The same rows from all pairs of sets that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct([w[i:i + 4] for i in range(1, greatest(2, len(w) - 3))]) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT d.doc_id, coalesce(len(g.s), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY 1, 2
"""
