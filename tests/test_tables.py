from pathlib import Path

import pytest

import __spark_entry__ as entry
from slidelake.operators.writer import create_deck, save_decks, write_decks
from slidelake.plans import builders as B
from slidelake.plans import catalog
from slidelake.sources.deck import Options
from slidelake.sources.package import Limits
from slidelake.sources.reader import read_decks
from slidelake.streaming import stream_decks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def same(spark, name, sf_dir=SF):
    """The query's rows and its SQL's, order aside."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = lambda it: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in it)
    key = lambda r: tuple(str(v) for v in r)
    mine = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()), key=key)
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), key=key)
    assert mine == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_files(spark, tmp_path):
    folder = tmp_path / "decks"
    folder.mkdir()
    (folder / "a.pptx").write_bytes(create_deck(B.scene([[B.text_box("a")], [B.text_box("b")]])))
    (folder / "b.pptx").write_bytes(b"no zip")
    (folder / "c.pptx").write_bytes(b"x" * 200_000)
    decks = read_decks(spark, str(folder), Options(limits=Limits(input_bytes=100_000)))
    assert {(Path(r.path).name, r.code) for r in decks.failed().collect()} == {("b.pptx", "invalid-package"), ("c.pptx", "resource-limit")}
    assert [r.plain_text for r in decks.elements.orderBy("slide_no").collect()] == ["a", "b"]
    with pytest.raises(RuntimeError):
        decks.raise_failed()
    q = stream_decks(spark, str(folder)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").where("status = 'ok'").count() == 1


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.pptx", ["n"])], "path string, names array<string>")
    out = save_decks(write_decks(rows, B.region_deck), str(tmp_path)).collect()
    assert (tmp_path / "x/a.pptx").stat().st_size == out[0].bytes
