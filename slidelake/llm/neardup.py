"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of few dimensions. Two vectors with cosine c lie at squared distance 2 - 2c; going round the blocks from some first one, the distance so far never exceeds the share of that many blocks. So each block is range-joined under its share, the blocks after it cut down what it finds, and the union of what is left is verified exactly.

Vectors travel as codes, rotated coordinates in 16 bits. What rounding can do to a distance is bounded: a pair below the bound links, a pair above it does not, and the few between are verified on the vectors themselves, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rebatched, written
from .graph import connected_components

#: Dimensions of a block; blocks at most (their dimensions grow beyond).
DIMS, BLOCKS = 4, 16
#: A code is a coordinate, -1 to 1, times this.
SCALE = 32_767
#: Vectors of a region of a block, about. A block has no more regions than REGIONS; their borders come from about SAMPLE vectors a region.
CHUNK, REGIONS, SAMPLE = 65_536, 8_192, 32
#: Vectors of a leaf, within a task: a 512th of all, between these.
LEAF = 4, 32
#: Pairs that are verified together.
PAIRS = 100_000
#: Added to squared distances in single precision, so that they never decide against a pair.
SLACK = 1e-6


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def splits(dim: int, blocks: int = BLOCKS) -> list[slice]:
    """Blocks of about DIMS dimensions, `blocks` of them at most, as equal as may be."""
    edges = np.linspace(0, dim, min(blocks, -(-dim // DIMS)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (packed doubles) and d (dimension) of the vectors that can link: not null, not zero, all components finite."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            ids, out, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and None not in v:
                    a = np.array(v, np.float64)
                    top = float(np.abs(a).max())
                    if np.isfinite(top) and top > 0:
                        ids.append(i)
                        out.append((a + 0.0).tobytes())  # -0.0 becomes 0.0
                        dims.append(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "v", "d"])

    return rows.mapInArrow(run, "vec_id long, v binary, d int")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; first scaled, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(v: np.ndarray) -> np.ndarray:
    """The codes of the rows of v at length 1, rotated."""
    return np.rint(unit(v) @ rotation(v.shape[1]) * SCALE).astype(np.int16)


def bounds(dim: int, least: float) -> tuple[int, int]:
    """Squared distances of codes: up to the first a pair links for sure, beyond the second it does not. A code is off by half a unit in each dimension at most."""
    reach, off = math.sqrt(max(0.0, 2 - 2 * least)) * SCALE, math.sqrt(dim) + 1e-4
    return math.floor((reach - off) ** 2) if reach > off else -1, math.ceil((reach + off) ** 2)


class Regions:
    """A block's space cut in halves by coordinates, level by level, at the medians of a sample: 2 ** levels regions. A vector's own region is its home; it visits those that come within reach of it."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        held = {1: sample}
        for node in range(1, 1 << levels):
            x = held.pop(node)
            spread = x.max(0) - x.min(0) if len(x) else np.zeros(sample.shape[1])
            a = self.axis[node] = int(spread.argmax())
            c = self.cut[node] = float(np.median(x[:, a])) if len(x) else 0.0
            held[2 * node], held[2 * node + 1] = x[x[:, a] < c], x[x[:, a] >= c]

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (vector, region, whether it is the home) of the vectors x."""
        at, node, home = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), bool)
        gap = np.zeros(x.shape)
        for _ in range(self.levels):
            a, c = self.axis[node], self.cut[node]
            away = x[at, a] - c
            right = away >= 0
            far = gap.copy()
            far[np.arange(len(at)), a] = np.maximum(far[np.arange(len(at)), a], np.abs(away))
            near = (far * far).sum(1) <= reach * reach
            node, home = np.concatenate([2 * node + right, (2 * node + ~right)[near]]), np.concatenate([home, np.zeros(near.sum(), bool)])
            at, gap = np.concatenate([at, at[near]]), np.concatenate([gap, far[near]])
        return at, node - (1 << self.levels), home


def leaves(x: np.ndarray) -> np.ndarray:
    """Indices of the rows of x, a leaf a row: halves of halves along the widest coordinate, about LEAF rows; -1 where a leaf has one row less than others."""
    held, most = [np.arange(len(x))], min(max(LEAF[0], len(x) // 512), LEAF[1])
    while max(len(held[0]), len(held[-1])) > most:
        halves = []
        for s in held:
            a = int((x[s].max(0) - x[s].min(0)).argmax())
            parts, half = np.argpartition(x[s, a], len(s) // 2), len(s) // 2
            halves += [s[parts[:half]], s[parts[half:]]]
        held = halves
    width = max(map(len, held))
    return np.stack([s if len(s) == width else np.append(s, np.full(width - len(s), -1)) for s in held])


def range_join(a: np.ndarray, b: np.ndarray | None, j: int, parts: list[slice], share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b; b None: pairs within a) of codes whose distance in block j may be within a share, and in it and the next within two. Leaves whose boxes lie further apart are not compared."""
    own, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    blocks = [parts[j], parts[(j + 1) % len(parts)]][: len(parts)]
    budget = np.float32(share / SCALE**2 + SLACK)
    mine = leaves(a[:, parts[j]].astype(np.float32))
    theirs = mine if own else leaves(b[:, parts[j]].astype(np.float32))

    def placed(x: np.ndarray, leaf: np.ndarray, p: slice, blank: float) -> np.ndarray:
        """The coordinates of a block by leaf; blank where there is no row."""
        out = x[leaf][:, :, p].astype(np.float32) / np.float32(SCALE)
        out[leaf < 0] = blank
        return out

    # What stands for no row is as far away as it gets: 4 in each dimension from any row, 8 from its like.
    left, right = [placed(a, mine, p, 4) for p in blocks], [placed(b, theirs, p, -4) for p in blocks]
    low = placed(b, theirs, parts[j], 4).min(1), placed(a, mine, parts[j], 4).min(1)
    high = right[0].max(1), placed(a, mine, parts[j], -4).max(1)
    # Squared distances as one product: (x, xx, 1) by (-2 y, 1, yy), of the first block and of both.
    square = lambda x: (x * x).sum(2, keepdims=True)
    left = [np.concatenate([x, square(x), np.ones_like(x[:, :, :1])], 2) for x in left]
    right = [np.concatenate([-2 * y, np.ones_like(y[:, :, :1]), square(y)], 2) for y in right]
    left, right = ([x[0], *([np.concatenate(x, 2)] if len(x) > 1 else [])] for x in (left, right))
    right = [np.ascontiguousarray(y.transpose(0, 2, 1)) for y in right]
    some = max(1, (1 << 21) // len(theirs))  # leaves at a time
    many = max(1, (1 << 20) // (mine.shape[1] * theirs.shape[1]))  # pairs of leaves at a time
    for s in range(0, len(mine), some):
        gap = np.maximum(np.maximum(low[1][s : s + some, None] - high[0][None], low[0][None] - high[1][s : s + some, None]), 0)
        p, q = np.nonzero((gap * gap).sum(2) <= budget)
        p += s
        if own:
            p, q = p[p <= q], q[p <= q]
        for t in range(0, len(p), many):
            u, v = p[t : t + many], q[t : t + many]
            good = left[0][u] @ right[0][v] <= budget
            if len(left) > 1:
                good &= left[1][u] @ right[1][v] <= 2 * budget
            if own:
                good &= (u != v)[:, None, None] | np.triu(np.ones(good.shape[1:], bool), 1)
            w, x = np.divmod(np.flatnonzero(good), good.shape[1] * good.shape[2])
            x, y = np.divmod(x, good.shape[2])
            if len(w):
                yield mine[u[w], x], theirs[v[w], y]


def block_links(a: np.ndarray, b: np.ndarray | None, j: int, parts: list[slice], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of codes that link or may, and whether they do for sure, for those whose first block from which the ring of blocks stays within its shares is j."""
    sure, most = bounds(a.shape[1], least)
    other = a if b is None else b
    dims = np.array([p.stop - p.start for p in parts])
    edges, shares = [p.start for p in parts], [most * np.cumsum(np.roll(dims, -q)) for q in range(len(parts))]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def verified() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, k = (np.concatenate([w[x] for w in waiting]) for x in (0, 1))
        waiting.clear()
        so_far = np.zeros(len(i), np.int64)
        for n, p in enumerate(parts[j:] + parts[:j]):  # round the ring from here
            diff = a[i, p].astype(np.int64) - other[k, p]
            so_far += (diff * diff).sum(1)
            keep = so_far * a.shape[1] <= shares[j][n]
            i, k, so_far = i[keep], k[keep], so_far[keep]
        diff = a[i].astype(np.int64) - other[k]
        d = np.add.reduceat(diff * diff, edges, axis=1)
        keep = np.ones(len(i), bool)
        for q in range(j):
            keep &= ~(np.cumsum(np.roll(d, -q, axis=1), axis=1) * a.shape[1] <= shares[q]).all(1)
        return i[keep], k[keep], d[keep].sum(1) <= sure

    n = 0
    for i, k in range_join(a, b, j, parts, most * int(dims.max()) / a.shape[1]):
        waiting.append((i, k))
        n += len(i)
        if n >= PAIRS:
            yield verified()
            n = 0
    if waiting:
        yield verified()


def joined_labels(label: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The labels, each a smaller index of its tree, after the pairs (i, k) have joined their trees."""
    while True:
        x, y = label[i], label[k]
        apart = x != y
        if not apart.any():
            return label
        i, k, x, y = i[apart], k[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def near_duplicates(vectors: DataFrame, least: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: how many others have a cosine of `least` or more with it, and the smallest vec_id reachable by such links.

    Equal vectors are joined as one, with a count, so copies are never paired. Vectors that are null, zero, or hold null or non-finite components have no links; vectors link only within a dimension. A block with more than `chunk` vectors is cut into regions at medians of a bounded sample (they deal out the work and change no result); a vector goes to its home and, for the pairs across a border, to a task with each region within reach. A task sends counts by vector, a label for each vector's tree and the pairs that rounding leaves open, not the links as pairs. Rows with a null id are returned without links; repeated ids are taken as copies of their own vector only if their vectors are equal, and share what is found for the id.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    members = written(usable(vectors).withColumn("h", F.sha2("v", 256)), "vectors")
    groups = members.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max("v").alias("v"), F.first("d").alias("d"))
    groups = written(groups, "groups")
    regions: dict[int, list[Regions]] = {}
    for row in groups.groupBy("d").count().collect():  # a row a dimension
        levels = min(max(0, math.ceil(math.log2(row["count"] / chunk))), REGIONS.bit_length() - 1)
        if levels:
            share = (SAMPLE << levels) / row["count"]
            got = groups.where((F.col("d") == row.d) & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v").collect()
            x = codes(np.frombuffer(b"".join(r.v for r in got), np.float64).reshape(-1, row.d))
            regions[row.d] = [Regions(x[:, p].astype(np.float64), levels) for p in splits(row.d)]
    sent = vectors.sparkSession.sparkContext.broadcast(regions)  # 16 B for each region of a block

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 500):
            for dim in set(batch.column("d").to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column("d"), dim))
                x = codes(np.frombuffer(b"".join(own.column("v").to_pylist()), np.float64).reshape(-1, dim))
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                for j, p in enumerate(splits(dim)):
                    at, leaf = np.arange(len(x)), np.zeros(len(x), np.int64)
                    other = leaf
                    if dim in sent.value:
                        reach = math.sqrt(bounds(dim, least)[1] * max(q.stop - q.start for q in splits(dim)) / dim) + 1
                        at, other, is_home = sent.value[dim][j].visits(x[:, p].astype(np.float64), reach)
                        home = np.zeros(len(x), np.int64)
                        home[at[is_home]] = other[is_home]
                        leaf = home[at]
                    n = len(at)
                    take = pa.array(at)
                    cols = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(np.minimum(leaf, other).astype(np.int32)), pa.array(np.maximum(leaf, other).astype(np.int32)), pa.array(leaf.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*cols, own.column("rep").take(take), own.column("copies").take(take), packed.take(take)], ["d", "j", "p", "q", "leaf", "rep", "copies", "code"])

    work = groups.select("rep", "copies", "v", "d").mapInArrow(dealt, "d int, j int, p int, q int, leaf int, rep long, copies long, code binary")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        dim, j, p, q = (x.as_py() for x in key)
        leaf, rep, n = (table.column(c).to_numpy() for c in ("leaf", "rep", "copies"))
        x = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(-1, dim)
        if p == q:
            left = right = np.arange(len(x))
        else:
            left, right = np.flatnonzero(leaf == p), np.flatnonzero(leaf == q)
        counts, label, open_ = np.zeros(len(x), np.int64), np.arange(len(x)), [np.zeros((2, 0), np.int64)]
        for i, k, sure in block_links(x[left], None if p == q else x[right], j, splits(dim), least):
            i, k = left[i], right[k]
            open_.append(np.stack([rep[i[~sure]], rep[k[~sure]]]))
            i, k = i[sure], k[sure]
            counts += (np.bincount(i, n[k], len(x)) + np.bincount(k, n[i], len(x))).astype(np.int64)
            label = joined_labels(label, i, k)
        met, low = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(x)))
        pairs = np.concatenate(open_, 1)
        blank = lambda m: pa.nulls(m, pa.int64())
        u = np.concatenate([rep[met], rep[low], pairs[0]])
        return pa.table({"u": pa.array(u), "v": pa.concat_arrays([blank(len(met)), pa.array(rep[label[low]]), pa.array(pairs[1])]), "n": pa.concat_arrays([pa.array(counts[met]), blank(len(low) + pairs.shape[1])]), "open": pa.array(np.arange(len(u)) >= len(met) + len(low))})

    found = written(work.groupBy("d", "j", "p", "q").applyInArrow(joined, "u long, v long, n long, open boolean"), "found")
    links = written(exact(found.where("open").select("u", "v"), groups, least), "links")
    counts = found.where("n is not null").select("u", "n").unionByName(links.select("u", F.col("nv").alias("n"))).unionByName(links.select(F.col("v").alias("u"), F.col("nu").alias("n"))).groupBy("u").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("n is null and not open").select("u", "v").unionByName(links.select("u", "v")))
    table = groups.select("h", "rep", "copies").join(counts, F.col("rep") == F.col("u"), "left").drop("u").join(components, F.col("rep") == F.col("node"), "left").drop("node")
    table = table.select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = members.select("vec_id", "h").join(table, "h").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(result.withColumnRenamed("vec_id", "id"), F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def exact(pairs: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose vectors have a cosine of `least` or more in double precision, with the copies nu and nv of either."""
    side = lambda c: groups.select(F.col("rep").alias(c), F.col("copies").alias(f"n{c}"), F.col("v").alias(f"vector_{c}"), F.col("d").alias(f"d{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            x, y = ([np.frombuffer(r, np.float64)[None, :] for r in batch.column(i).to_pylist()] for i in (4, 5))
            links = [bool((unit(p) * unit(q)).sum() >= least) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["u", "v", "nu", "nv"]).filter(pa.array(links, pa.bool_()))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").where("du = dv")
    return joined.select("u", "v", "nu", "nv", "vector_u", "vector_v").mapInArrow(run, "u long, v long, nu long, nv long")


#: The same rows from all pairs.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
w AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0 AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
