"""Keys beyond those of the small tables, and tables of many rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_tables import same

from slidelake.functions import ooxml
from slidelake.operators.writer import package_parts, zip_package
from slidelake.plans import builders as B
from slidelake.plans import catalog
from slidelake.sources import package
from slidelake.sources.deck import Options, parse_deck

A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def test_column_names_beyond_three_letters(spark, tmp_path):
    keys = [-1, 0, 1, 26, 27, 702, 703, 18278, 18279, 18304, 18305, 18954, 18955, 19999, 60_000, 129_142, 129_143, 1_200_000, 37_000_000, None]
    duckdb.execute(f"COPY (SELECT unnest(?::BIGINT[]) AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)", [keys])
    same(spark, "column_names", str(tmp_path))


def test_column_name_of_any_length(spark):
    keys = [1, 26, 27, 702, 703, 18278, 18279, 475_254, 475_255, 12_356_630, 12_356_631, 2**53 + 1, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "n long").select("n", ooxml.column_name_col(F.col("n")).alias("name")).collect()
    assert {r.n: r.name for r in rows} == {k: ooxml.column_name(k) for k in keys}


def tree(node):
    return (node.tag, node.attrs, node.text, node.order, [tree(c) for c in node.children])


TEXTS = ("", "x", " ", "a b", "1-2", "&amp;", "&#65;", "_x0041_", "é\U0001f600", "\n", "\r\n", "?", "a]]b", "\t", "~0", "?~0", "~1?", "~0.")
CELLS = (
    "<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:rPr/><a:t>{}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>",
    '<a:tc rowSpan="3"><a:txBody><a:p><a:r><a:rPr lang="en" b:q="1"/><a:t xml:space="preserve">{}</a:t></a:r></a:p></a:txBody><a:tcPr anchor="ctr"/></a:tc>',
    "<a:tc>{}</a:tc>", "<a:tc><a:p/>{}</a:tc>", '<a:tc vMerge="1"/>', '<a:tc vMerge="1"><a:txBody><a:p/></a:txBody></a:tc>', "<a:tc><a:tc><a:t>{}</a:t></a:tc></a:tc>",
    "<a:tc><a:txBody><a:p><a:r><a:t>{}</a:t></a:r><a:r><a:t>{}</a:t></a:r></a:p></a:txBody></a:tc>", '<a:tc xmlns:a="urn:other"><a:t>{}</a:t></a:tc>', '<a:tc x="a>b"><a:t>{}</a:t></a:tc>', "<a:tc><a:t>{}</a:r></a:tc>", "<a:tc><a:é>{}</a:é></a:tc>",
    '<a:tc><a:t b:q="1" c:q="1">{}</a:t></a:tc>', "<a:tc><!-- <a:t>{}</a:t> --></a:tc>", "<a:tc><a:t>\x01{}</a:t></a:tc>",
)


def read_xml(text, limits):
    try:
        root, n = package.parse_xml(text.encode(), limits)
        return tree(root), n
    except package.PackageError as e:
        return e.code, str(e)


@pytest.mark.parametrize("seed", range(300))
def test_cells_of_one_shape_are_read_like_others(monkeypatch, seed):
    r = random.Random(seed)
    kinds = r.sample(CELLS[:2] + CELLS[4:6], 3) + (r.sample(CELLS, 1) if r.random() < 0.6 else [])
    rows = "".join(f'<a:tr h="{i}">' + "".join(k.replace("{}", r.choice(TEXTS)) for k in r.choices(kinds, weights=[30, 30, 30, 1][: len(kinds)], k=3)) + r.choice(["", "", "", " ", "\n"]) + ("t" if r.random() < 0.01 else "") + "</a:tr>" for i in range(12))
    text = f'<?xml version="1.0"?><p:x xmlns:p="urn:p" xmlns:a="{A}" xmlns:b="urn:b" xmlns:c="urn:b"><a:tbl>{rows}</a:tbl>{r.choice(["", "", "", "</p:x>"])}</p:x>'
    for limits in (package.Limits(), package.Limits(xml_nodes=r.randint(5, 400)), package.Limits(xml_depth=r.randint(2, 10))):
        monkeypatch.setattr(package, "LEAST_CELLS", 1)
        got = read_xml(text, limits)
        monkeypatch.setattr(package, "LEAST_CELLS", 1 << 60)
        assert got == read_xml(text, limits)


def test_table_cells_alone_are_those_among_all_tables():
    """Cells that differ only in their text, and others, with and without what else a deck has."""
    rows = [[{"text": t}, {"text": f"{i}"}, {"text": "m", "rowSpan": 2} if i % 2 == 0 else {"vMerge": True}, {"text": "f", "fillColor": "#112233", "borders": {"top": {"color": "#445566"}}}, {"text": "two\nlines"}] for i, t in enumerate(TEXTS * 3)]
    raw = zip_package(package_parts(B.scene([[B.table_of(rows)]])))
    own = parse_deck(raw, "", Options(tables=frozenset({"table_cells"})))
    assert own["table_cells"] == parse_deck(raw)["table_cells"] and len(own["table_cells"]) == 5 * len(rows)
    assert [c["text"] for c in own["table_cells"] if c["col_no"] == 1] == [str(i) for i in range(len(rows))]


def test_a_deck_for_many_orders(spark):
    """Lines of many orders share a deck: far fewer decks than orders."""
    lines = spark.createDataFrame([(f"{i // 3}-{i % 3}", str(i), "1") for i in range(9000)], "line string, part string, quantity string").coalesce(1)
    assert 5 <= catalog.in_blocks(lines, B.tables_deck).packages.count() <= 300  # a batch of rows that Spark sends bounds a block, too


def test_lines_with_nulls_and_odd_values(spark, tmp_path):
    """Null keys, numbers and quantities, negative ones, halves, and lines that are the same."""
    lines = [(1, 1, 5, 2.5), (1, 2, None, 3.5), (1, 2, 5, 17.5), (None, 1, 7, 1.0), (None, None, None, None), (2, None, 8, 0.5), (3, -4, 9, -2.5), (3, None, 9, 1.0), (-5, -6, -7, 0.0), (4, 1, 1, 1.0), (4, 1, 1, 1.0)]
    duckdb.execute(f"COPY (SELECT unnest(?::STRUCT(l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_quantity DOUBLE)[], recursive := true)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)", [[dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), x, strict=True)) for x in lines]])
    same(spark, "table_cells", str(tmp_path))
    same(spark, "table_merges", str(tmp_path))
