"""Packages that arrive: the same pass over a stream of files. It keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidelake.sources.deck import Options
from slidelake.sources.reader import parse_packages


def stream_decks(spark: SparkSession, path: str, options: Options | None = None, max_files: int = 1000) -> DataFrame:
    """A streaming DataFrame of deck rows for the packages that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pptx").option("maxFilesPerTrigger", max_files).load(path)
    return parse_packages(files.select("path", "content"), options)
