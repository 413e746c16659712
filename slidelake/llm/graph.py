"""Connected components over an edge table, with no edge list on the driver or in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


class Forest:
    """Union-find over any hashable nodes; the smallest node of a tree is its root. Tells which links join two trees."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (n := up.get(r, r)) != r:
            r = n
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Edges that a task contracts together.
BLOCK = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of a task's edges as stars around its trees' smallest nodes: no more rows than nodes."""

    def stars(forest: Forest) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    forest, n = Forest(), 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        n += batch.num_rows
        if n >= BLOCK:
            yield stars(forest)
            forest, n = Forest(), 0
    yield stars(forest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable from node. Nodes without an edge do not appear.

    Rounds of contraction: each task turns its block of edges into stars, then every node points at the smallest node among its neighbours and itself, as do those neighbours (alternating large and small stars). A round's edges go to a table in the shared folder. Ends when no centre of a star points further and no node has two centres.
    Null ends and self-loops are ignored; repeated edges count once.
    """
    e = edges.toDF("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    for _ in range(max_rounds):
        twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        further = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi")
        if not twice.union(further).limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        # Large star: neighbours above u point at the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below u and u itself point at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        before, e = e, written(small.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
        discard(before)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
