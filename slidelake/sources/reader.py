"""Decks as Spark tables: a narrow pass over binary files, one package a row, then explodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slidelake.sources.deck import Options, parse_deck
from slidelake.sources.schema import TABLES, deck_row

_MAPS = {"elements": "keypoints", "xml_nodes": "attrs"}


#: Decks, bytes of packages, and rows of tables that go to the JVM together.
BATCH_DECKS, BATCH_BYTES, BATCH_ROWS = 256, 4 << 20, 1 << 15


def arrow_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of decks. A deck with a value that its column can't hold becomes a failed one."""
    for row in rows:
        for table, column in _MAPS.items():
            for r in row.get(table) or []:
                if isinstance(r.get(column), dict):
                    r[column] = list(r[column].items())
    full = [{f.name: row.get(f.name, [] if pa.types.is_list(f.type) else None) for f in schema} for row in rows]
    try:
        return pa.RecordBatch.from_pylist(full, schema=schema)
    except (pa.ArrowException, OverflowError, ValueError) as e:
        if len(rows) > 1:
            return pa.Table.from_batches([arrow_rows([row], schema) for row in rows]).combine_chunks().to_batches()[0]
        bare = {k: rows[0].get(k) for k in ("deck_id", "path", "byte_length")}
        return arrow_rows([bare | {"status": "failed", "code": "invalid-content", "message": str(e)}], schema)


def read_binary(spark: SparkSession, path: str, limit_bytes: int | None = None) -> DataFrame:
    """path and content of the packages under a folder. Files beyond limit_bytes are told by their length alone, before any byte is read: content is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").load(path)
    if limit_bytes is None:
        return files.select("path", "content")
    large = files.where(F.col("length") > limit_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= limit_bytes).select("path", "content").unionByName(large)


def parse_packages(packages: DataFrame, options: Options | None = None, must: bool = False, tables: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A row for each deck (schema.deck_row) from path and content, with the tables that are named, or all, and of their columns those that are named, or all.

    One narrow pass; a deck's budgets hold within its row, and a bad deck is a row with its error, not a failed job, unless all `must` be read: then it raises RuntimeError. Null content counts as beyond the input limit. Tables that nobody asked for are neither kept nor sent.
    """
    options = options or Options()
    kept = tuple(TABLES) if tables is None else tuple(t for t in TABLES if t in set(tables))
    options = replace(options, tables=frozenset(kept))
    ddl = deck_row(kept, columns)
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[dict]) -> pa.RecordBatch:
            batch = arrow_rows(rows, schema)
            if must:
                for path, status, code, message in zip(*(batch.column(c).to_pylist() for c in ("path", "status", "code", "message")), strict=True):
                    if status == "failed":
                        raise RuntimeError(f"{path}: {code}: {message}")
            return batch

        waiting, size, rows = [], 0, 0
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                if (content := raw.as_py()) is None:
                    waiting.append({"path": path.as_py(), "status": "failed", "code": "resource-limit", "message": "no content, or more than allowed"})
                else:
                    waiting.append(parse_deck(content, path.as_py(), options))
                    size += len(content)
                    rows += sum(len(v) for k, v in waiting[-1].items() if k in kept)
                if len(waiting) >= BATCH_DECKS or size >= BATCH_BYTES or rows >= BATCH_ROWS:
                    yield sent(waiting)
                    waiting, size, rows = [], 0, 0
        if waiting:
            yield sent(waiting)

    return packages.select("path", "content").mapInArrow(run, ddl)


def table(decks: DataFrame, name: str, *keep: str) -> DataFrame:
    """One of the deck's tables, its rows with deck_id and the named columns of the deck."""
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return decks.select("deck_id", *keep, F.inline(name))


class Decks:
    """The tables of parsed decks by name: decks.slides, decks.elements and so on."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.rows, name)

    @property
    def info(self) -> DataFrame:
        return self.rows.drop(*TABLES)

    def failed(self) -> DataFrame:
        return self.info.where("status = 'failed'").select("deck_id", "path", "code", "message")

    def raise_failed(self) -> None:
        """RuntimeError with the first failure, if there is one."""
        if bad := self.failed().limit(1).collect():
            raise RuntimeError(f"{bad[0].path}: {bad[0].code}: {bad[0].message}")


def read_decks(spark: SparkSession, path: str, options: Options | None = None) -> Decks:
    options = options or Options()
    return Decks(parse_packages(read_binary(spark, path, options.limits.input_bytes), options))
