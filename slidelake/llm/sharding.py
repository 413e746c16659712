"""Sharding: longest-processing-time scheduling of groups that must stay together, through a heap. The law is `bytes`: shard sizes near equal."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups are scheduled in bundles, a bundle being the groups whose digest falls on it. Their number bounds what the driver holds at any input size.
BUNDLES = 1 << 16
#: Parts of a shard in which slots are numbered.
PARTS = 2048


def schedule(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each bundle: largest first, ties by number, each to the least-loaded shard (ties: the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for b, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[b] = s
        heapq.heappush(heap, (load + size, s))
    return out


def sharded(docs: DataFrame, shards: int = 24, bundles: int = BUNDLES, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Documents with equal texts share a shard; a null text counts as empty. Groups are scheduled in bundles of equal digest remainder, the same at every size, so shards differ by about a bundle of small groups at most (a `bundles`th of all bytes), and a group that is larger than its bundle's rest is scheduled as if alone. size: UTF-8 bytes and 8. slot counts from 0 within the shard without gaps: documents are numbered in parts of the shard dealt by id, and a prefix sum over the parts (shards x parts rows) gives each its base. Repeated rows have slots of their own, in no stated order. grown_shard belongs to another law and is null. Only ids, sizes and digests cross a shuffle; sums by bundle are added up before it, so a group with a third of all rows is one row a task there.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.pmod(F.xxhash64(F.sha2(raw, 256)), F.lit(bundles)).cast("int").alias("bundle"))
    sums = rows.groupBy("bundle").agg(F.sum("size").alias("size")).collect()  # `bundles` rows at most
    to = schedule({r.bundle: r.size for r in sums}, shards)
    plan = docs.sparkSession.createDataFrame(sorted(to.items()), "bundle int, shard int")
    placed = rows.join(F.broadcast(plan), "bundle").withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    bases = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("i", F.row_number().over(within) - 1)
    joined = numbered.join(F.broadcast(bases), ["shard", "part"])  # shards x parts rows
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("i")).cast("int").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
