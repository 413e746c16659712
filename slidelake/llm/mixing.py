"""Mixing sources to target weights: Efraimidis-Spirakis sampling with DataFrame functions only.

Each document draws a key -ln(u) / w, u from a hash of its id and w its quality weight; small keys come first within the source. A source takes whole epochs first, then documents in order of their keys until their words reach what is left of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: Weights of the sources in the order of their names, repeating; share of all words to take; epochs at most.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Key ranges of a source. Only the range in which its budget ends is sorted row by row.
RANGES = 4096
#: Rows of the table of sources up to which it is broadcast.
SOURCE_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, 0.25 to 1: low where the text has many symbols of markup for its words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(1.0) / (1.0 + F.least(F.lit(3.0), symbols / F.greatest(size, F.lit(1)))), F.lit(1.0))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the id: 52 bits of md5, which other engines have too."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size): the sources share `share` times all words by weight, none above `cap` times its own; the excess goes to the others by weight until none is above.

    Sources are sorted by the level at which they fill up; a prefix sum gives the first level that the rest can hold. One row a source: the windows here see sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", given.cast("double")).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    s = s.withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", F.when(level <= F.col("full_at"), level))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __size, __source, __id, __key and __span, the range that the key falls in."""
    size = n_words(F.col("text"))
    w = quality_weight(F.col("text"), F.col("__size"))
    rows = docs.withColumns({"__size": size, "__source": F.col("source").cast("string"), "__id": F.col("doc_id").cast("long")})
    rows = rows.withColumn("__key", -F.log(uniform(F.col("__id"))) / w)
    # Grows with the key from 0 to 1. A document of weight w is below a key with a chance of 1 - exp(-key w); the mean over three weights leaves no range with more than about three times its share of a source.
    below = 1 - (F.exp(-F.col("__key")) + F.exp(-F.col("__key") / 2) + F.exp(-F.col("__key") / 4)) / 3
    return rows.withColumn("__span", F.least(F.lit(RANGES - 1), F.floor(below * RANGES)).cast("int"))


def source_plan(rows: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """For each source of keyed rows: size, target, whole epochs, the rest of its budget, and the range in which the rest ends, with the words before it. Broadcast if a count shows that it is small."""
    spans = rows.groupBy("__source", "__span").agg(F.sum("__size").alias("span_size"))
    sizes = spans.groupBy(F.col("__source").alias("source")).agg(F.sum("span_size").alias("source_size"))
    plan = source_targets(sizes, weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("__source").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a source at most
    begins = spans.withColumn("begin", F.coalesce(F.sum("span_size").over(before), F.lit(0)))
    # The last range that begins before the rest ends.
    ends = begins.join(plan.select("source", "rest"), F.col("__source").eqNullSafe(F.col("source"))).where("begin < rest").groupBy("__source").agg(F.max(F.struct("__span", "begin")).alias("e"))
    ends = ends.select(F.col("__source").alias("end_source"), F.col("e.__span").alias("end_span"), F.col("e.begin").alias("begin"))
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")
    plan = written(plan.select(*(F.col(c).alias(f"__plan_{c}") for c in plan.columns)), "plan")
    return F.broadcast(plan) if plan.limit(SOURCE_ROWS + 1).count() <= SOURCE_ROWS else plan


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Keyed rows with their source's plan, __at_end (their range is the one in which the budget ends) and __inside (it lies before)."""
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__plan_source")), "left")
    end = F.col("__plan_end_span")
    return rows.withColumns({"__at_end": F.coalesce(F.col("__span") == end, F.lit(False)), "__inside": F.coalesce(F.col("__span") < end, F.lit(False)).cast("int")})


def _fits(rows: DataFrame) -> DataFrame:
    """Of rows at the end of their source's budget: __fits, 1 if at least half of the document fits in, else 0."""
    order = Window.partitionBy("__source").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("__plan_begin") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    return rows.withColumn("__fits", (begin + F.col("__size") / 2 <= F.col("__plan_rest")).cast("int"))


def _keys(docs: DataFrame) -> DataFrame:
    """What the plan needs of each document, as a table without texts, so that words are counted once."""
    return written(keyed(docs.select("doc_id", "text", "source")).select("__id", "__source", "__size", "__key", "__span"), "keys")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (times the document is taken) of every document.

    No text is shuffled. Sums by (source, key range) settle all ranges but the one in which a source's budget ends; only its rows are numbered one by one, so no task holds a source. The document at the budget's end is taken if at least half of it fits, so a source misses its target by half a document at most. Null texts have size 0; a null source is a source, last in order; documents of size 0 are taken 0 words. Equal keys are ordered by id; repeated rows are separate documents. Other columns of docs are ignored.
    """
    keys = _keys(docs)
    rows = _placed(keys, source_plan(keys, weights, share, cap)).select("__id", "__size", "__source", "__key", "__at_end", "__inside", "__plan_source_size", "__plan_target", "__plan_epochs", "__plan_begin", "__plan_rest")
    done = rows.where(~F.col("__at_end")).withColumn("__fits", F.col("__inside")).unionByName(_fits(rows.where("__at_end")))
    copies = F.least(F.lit(cap), F.col("__plan_epochs") + F.col("__fits"))
    return done.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__plan_source_size").alias("source_size"), F.col("__plan_target").alias("target"), (F.col("__size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    Texts stay where they are: only the ids of rows at a budget's end travel. Rows that share an id there are taken if one of them is.
    """
    keys = _keys(docs)
    plan = source_plan(keys, weights, share, cap)
    rows = _placed(keyed(docs), plan)
    fit = _fits(_placed(keys, plan).where("__at_end")).where("__fits = 1").select(F.col("__id").alias("__fit_id")).distinct()
    if fit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        fit = F.broadcast(fit)
    rows = rows.join(fit, F.col("__at_end") & F.col("__id").eqNullSafe(F.col("__fit_id")), "left")
    more = F.col("__inside") + (F.col("__at_end") & F.col("__fit_id").isNotNull()).cast("int")
    copies = F.least(F.lit(cap), F.col("__plan_epochs") + more)
    rows = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*(rows[c] for c in docs.columns))


#: The same rows by sorting each source whole.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1.0 / (1.0 + least(3.0, symbols::DOUBLE / greatest(size, 1)))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS full_at, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT max(level) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, CASE WHEN m.level IS NULL OR full_at <= m.level THEN cap ELSE m.level * w END AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
o AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, least(2, epochs + CASE WHEN before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END)::INT AS copies FROM o)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
