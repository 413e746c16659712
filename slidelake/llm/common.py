"""Helpers that the training-data operators share: shared folders, hashing folds, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of longs may be broadcast: 4 Mi rows, about 32 MB of ids.
BROADCAST_ROWS = 1 << 22


#: Rows and bytes of an Arrow batch of texts: about 1.5 MB at 3 KB a text, in the JVM and in the worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts small enough for several at once beside a full heap; what the session sets itself stays."""
    own = spark.conf.getAll
    for name, value in BATCHES.items():
        if name not in own:
            spark.conf.set(name, value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set if driver and executors are one process; else it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.slidelake.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="slidelake-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.slidelake.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of written tables that have not been deleted, oldest first.
_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. `discard` takes it away."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/slidelake-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    out.slidelake_folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _folders:
        _folders.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.slidelake_folder)


def written_alone(df: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that df() gives, written; what was written on the way to it is deleted."""
    before = set(_folders)
    out = written(df(), name)
    for path in [p for p in _folders if p not in before and p != out.slidelake_folder]:
        _delete(out.sparkSession, path)
    return out


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; an id that is null counts as 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids. ids goes to all executors only where a count proves it to be small; else Spark joins by shuffle."""
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def sampled_by_class(df: DataFrame, cls: str, key: str, per_class: int, classes: int = 1024) -> tuple[DataFrame, dict]:
    """A sample for fitting: about per_class keys of each value of cls, chosen by a hash of the key, so reruns agree. And for each value how many rows of df a sampled one stands for.

    The share for each class comes from a count over all rows; no row order and no partitioning play a part. No class is left out: more than `classes` of them are an error.
    """
    counts = {r[0]: r["count"] for r in df.groupBy(cls).count().limit(classes + 1).collect()}
    if len(counts) > classes:
        raise ValueError(f"more than {classes} values of {cls}")
    weights = {c: max(1.0, n / per_class) for c, n in counts.items()}
    if not weights:
        return df.limit(0), weights
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for c in sorted(weights) for x in (c, 1 / weights[c])))
    return df.where(u < F.try_element_at(share, F.col(cls))), weights


def one_text_an_id(df: DataFrame, cls: str) -> DataFrame:
    """doc_id, cls and text: of rows that share id and class one, the least text, so that a sample of ids is a sample of rows."""
    return df.groupBy("doc_id", cls).agg(F.min("text").alias("text")).select("doc_id", cls, "text")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column; null becomes the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


_cached: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in this worker from task to task. What other operators kept is dropped: workers are used again by one after the other."""
    for other in [k for k in _cached if k != owner]:
        del _cached[other]
    return _cached.setdefault(owner, {})


def rebatched(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that working memory stays small beside long texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def give_back() -> None:
    """Returns memory that this worker no longer uses; it stays idle beside the executor's other work."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


#: Texts, and bytes of texts, that are cut together, so that their common pieces count once.
TOGETHER, BYTES = 4000, 16 << 20


def together(batches: Iterator[pa.RecordBatch], most: int = TOGETHER, limit: int = BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null as empty), `most` rows or `limit` bytes at a time, about."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.Array, pa.Array]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        return table.column(0).combine_chunks(), table.column(1).cast(pa.large_string()).combine_chunks().fill_null("")

    rows = size = 0
    for batch in rebatched(batches):
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= limit:
            yield joined()
            waiting.clear()
            rows = size = 0
    if rows:
        yield joined()
