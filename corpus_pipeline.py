"""The corpus pipeline: identify languages, judge quality, keep one document of each near-duplicate group, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. Models are fitted on the stage's own input and, for quality, the folder's labels. Null, empty and wordless texts are rejected by the first two stages; the docstrings of the operators say what the others make of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slidelake.llm import bpe, jaccard, langid, mixing, quality
from slidelake.llm.common import discard, read_table, small_batches, written_alone


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    small_batches(spark)
    return langid.identified_documents(docs, langid.fit_language_id(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep."""
    small_batches(spark)
    return quality.kept_documents(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document taken."""
    small_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the fitted models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written and read again as the next one's input; what a stage no longer needs is deleted."""
    docs, last = read_table(spark, sf_dir, "documents"), STAGES[-1][1]
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written_alone(partial(stage, spark, docs, sf_dir), f"stage{i}")
        if i:
            discard(before)
    return last(spark, docs, sf_dir)
