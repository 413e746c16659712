"""Keys and texts beyond the limits of a part: cut into blocks and put together again."""

import pytest
from pyspark.sql import functions as F
from test_tables import same

from slidelake.plans import builders as B
from slidelake.plans import catalog


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Most rows belong to one customer, one order and one user; texts have more lines or bytes than a part may hold."""
    folder = str(tmp_path_factory.mktemp("hot"))
    texts = [(1, "".join(f"line {i}\n" if i % 7 else "\n" for i in range(105_000))), (2, "x&" * 2_500_000 + "\n\ny\n"), (3, ""), (4, "a\n\nb"), (4, "same id"), (None, "no id\n")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet.d")
    n = spark.range(90_000).withColumnRenamed("id", "i")
    priority = F.when((F.col("i") % 5 == 0) | F.col("i").between(3000, 9000), "1-URGENT").otherwise("5-LOW")
    n.select((F.col("i") * 3).alias("o_orderkey"), F.when(F.col("i") % 100 == 0, F.col("i")).otherwise(7).alias("o_custkey"), priority.alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet.d")
    lines = spark.range(20_500).select(F.when(F.col("id") < 20_000, 5).otherwise(F.col("id")).alias("l_orderkey"), (F.col("id") + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50).alias("l_partkey"), F.lit(3.0).alias("l_quantity"))
    lines.write.parquet(f"{folder}/lineitem.parquet.d")
    spark.range(7000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 6000, 1).otherwise(F.col("id") % 10).alias("user_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type")).write.parquet(f"{folder}/events.parquet.d")
    import duckdb

    for name in ("documents", "orders", "lineitem", "events"):
        duckdb.execute(f"COPY (SELECT * FROM read_parquet('{folder}/{name}.parquet.d/*.parquet')) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["text_extract", "paragraph_split", "run_merge", "table_cells", "table_merges", "scene_issues"])
def test_hot_key(spark, hot, name):
    same(spark, name, hot)


def test_failed_deck_raises(spark, hot, monkeypatch):
    monkeypatch.setattr(catalog, "PIECE_LINES", 200_000)
    with pytest.raises(Exception, match="resource-limit"):
        catalog.text_extract(spark, hot).collect()


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n\n\nb\n", "ab\ncd\ne" * 9])
def test_pieces(text):
    cut = list(B.pieces(text, 5, 2))
    assert "".join(cut) == text and all(len(x) <= 5 and x.count("\n") <= 2 for x in cut) and (text == "" or "" not in cut)
