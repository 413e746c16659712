"""Token-ID files: flat unsigned integers beside 64-bit document offsets, written by partition and memory-mapped on reading.

A part is two files. `.bin` holds the ids, little-endian, 16 bits wide if the vocabulary allows, else 32. `.idx` holds an 8-byte magic, the id width in bytes, the number n of documents, n + 1 offsets (in ids, from the part's start) and n document ids, all 64-bit integers. A part's base, the number of ids in all parts before it, comes from prefix sums over the manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shared_root, together, worker_cache, written
from .pretokens import Memory, chunks, laid_out, large_memory, marks

MAGIC = b"SLTOKEN1"
NO_ID = -(1 << 63)  # stands for a doc_id that is null
#: Entries of a worker's memory of finished pieces.
PIECES = 1 << 20
#: Pieces that the library takes as one text.
RUN = 2000


class Encoder:
    """Encodes with a tokenizers file whose pre-tokens follow the byte-level pattern. A batch is cut into pieces that the pattern never crosses; equal pieces go through the library once while they are remembered.

    The library cuts texts at added tokens before the pattern sees them, which changes matches of white space beside them, so a text that holds one goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of an id: a character stands for a byte
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.memory = Memory(PIECES)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """New pieces and their ids. Those that start with a space before another character are cut off again wherever they stand, so runs of them go as one text; token widths tell where each ends."""
        alone = [x for x in new if len(x) < 2 or x[0] != " " or x[1].isspace()]
        for x, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield x, np.array(e.ids, dtype=self.dtype).tobytes()
        rest = [x for x in new if len(x) > 1 and x[0] == " " and not x[1].isspace()]
        for i in range(0, len(rest), RUN):
            part = rest[i : i + RUN]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(x.encode("utf-8")) for x in part])
            cut = [0, *(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()]
            packed, n = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            for x, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                yield x, packed[n * a : n * b]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _packed(self, found: list[str]) -> list[bytes]:
        """The ids of each piece, all different; the library gets the new ones."""
        known, old = self.memory.turn(), self.memory.old
        got = list(map(known.get, found))
        if None in got:
            new, at = [], []
            for i, ids in enumerate(got):
                if ids is None:
                    x = found[i]
                    if (ids := old.get(x)) is None:
                        new.append(x)
                        at.append(i)
                    else:
                        got[i] = known[x] = ids
            where = dict(zip(new, at, strict=True))
            for x, ids in self._library(new):
                got[where[x]] = known[x] = ids
        return got

    def encode_batch(self, batch: list[str] | pa.Array) -> list[bytes]:
        """The packed ids of each text. Arrow finds the texts that can be cut, cuts them at the marks, numbers the distinct pieces and lays out their ids; Python sees distinct pieces only."""
        batch = batch if isinstance(batch, pa.Array) else pa.array(batch, pa.large_string())
        marked = marks(batch, self.added)
        ids, at = laid_out(marked, self._packed, self.dtype)
        raw, n = memoryview(ids).cast("B"), self.dtype.itemsize
        out: list[bytes] = [raw[a:b] for a, b in zip((at[:-1] * n).tolist(), (at[1:] * n).tolist(), strict=True)]
        for i in np.flatnonzero(marked.is_null().to_numpy(zero_copy_only=False)).tolist():
            text = batch[i].as_py()
            out[i] = self._whole(text) if any(x in text for x in self.added) else self._pieces(text)
        return out

    def _pieces(self, text: str) -> bytes:
        parts = chunks(text)
        once = list(dict.fromkeys(parts))
        return b"".join(map(dict(zip(once, self._packed(once), strict=True)).__getitem__, parts))


def encoder(path: str) -> Encoder:
    kept = worker_cache("token files")
    if path not in kept:
        large_memory()
        kept[path] = Encoder(path)
    return kept[path]


def _local(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for other stores."""
    at = urlsplit(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


@contextmanager
def _new_file(uri: str) -> Iterator[BinaryIO]:
    """A file to write to, which appears under its name when it is whole."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".tmp", "wb") as f:
            yield f
        os.replace(path + ".tmp", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".tmp") as f:
        yield f
    store.move(path + ".tmp", path)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the store is a file system, else read."""
    if (path := _local(uri)) is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(docs: DataFrame, path: str, out: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Encodes every whole text with the tokenizers file at `path`, appends end_id (None: nothing) and writes parts in ascending doc_id order.

    Returns the manifest: part, uri (without extension), n_docs, n_ids, base. Texts cross one range shuffle, into as many parts as docs has partitions to read (or the session shuffles into, if that is more); ids go to the file as they are made. A repeated task writes files of its own and the manifest names only those of the task that counted; what a lost task leaves stays in the folder, unnamed. Null texts are empty; null ids come first; repeated rows stay.
    """
    spark = docs.sparkSession
    out = out or f"{shared_root(spark)}/slidelake-{uuid.uuid4().hex}/tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        uri = f"{out}/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        end = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        sizes, names = array("q"), array("q")
        with ExitStack() as files:
            bin_ = None
            for ids, batch in together(batches):
                bin_ = bin_ or files.enter_context(_new_file(uri + ".bin"))
                names.extend(ids.fill_null(NO_ID).to_pylist())
                for packed in enc.encode_batch(batch):
                    bin_.write(packed)
                    bin_.write(end)
                    sizes.append((len(packed) + len(end)) // enc.dtype.itemsize)
        if not names:
            return
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).astype("<i8")
        with _new_file(uri + ".idx") as f:
            for x in (MAGIC, np.array([enc.dtype.itemsize, len(names)], dtype="<i8"), offsets, np.frombuffer(names, np.int64).astype("<i8")):
                f.write(x if isinstance(x, bytes) else x.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(names)], "n_ids": [int(offsets[-1])]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    manifest = written(rows.mapInArrow(run, "part long, uri string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the parts, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                idx = _mapped(uri + ".idx", "<i8")
                if idx[:1].tobytes() != MAGIC:
                    raise ValueError(f"{uri}.idx is not a token index")
                width, n = int(idx[1]), int(idx[2])
                off, names = idx[3 : n + 4], idx[n + 4 : 2 * n + 4]
                ids = _mapped(uri + ".bin", f"<u{width}")
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None if x == NO_ID else x for x in names.tolist()], pa.int64()), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A row names a whole part, so rows are dealt out one by one.
    return manifest.select("uri", "base").repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
