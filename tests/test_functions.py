import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidelake.functions import color, geometry, ooxml


def test_numbers_as_javascript_prints_them():
    shown = {1e21: "1e+21", 0.1: "0.1", 1e-7: "1e-7", 5.0: "5", -0.0: "0", 1.5e-6: "0.0000015", 123456789012345680000.0: "123456789012345680000", -2.5: "-2.5"}
    assert {x: ooxml.js_number(x) for x in shown} == shown


def test_rounding():
    assert ooxml.js_round(-2.5) == -2 and ooxml.js_round(2.5) == 3
    assert ooxml.to_fixed(1.00105) == 1.001  # the binary value lies below
    with pytest.raises(ValueError):
        ooxml.units(2**53, 1)
    with pytest.raises(ValueError):
        ooxml.units(math.inf, 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(-10_000_000, 10_000_000))
def test_emu(emu):
    assert ooxml.emu_to_points(emu) == round(emu * 72 / 914400, 4)


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_text_survives_escapes(text):
    t = ooxml.xml_filtered(text)
    assert ooxml.decode_office(ooxml.decode_entities(ooxml.escape_xml(t))) == t


def test_entities_once():
    assert ooxml.decode_entities("&amp;lt; &#x41;&#65; &#x110000; &QUOT;") == "&lt; AA &#x110000; \""


def test_office_surrogates():
    assert ooxml.decode_office("_xD83D__xDE00_") == "\U0001f600"


def test_plain_texts_differ():
    html = "<ul><li><p>a</p></li></ul><p>b<br>c&nbsp;</p>"
    assert ooxml.plain_preview(html) == "a\n\nb\nc "
    assert ooxml.plain_render(html) == "• a\n\nb\nc"


def test_links():
    assert ooxml.sanitize_link(" HTTPS://a.b/c ") == "HTTPS://a.b/c"
    assert ooxml.sanitize_link("mailto:x@y") == "mailto:x@y"
    for bad in ("javascript:x", "/a", "http://", "", None, "ftp://a"):
        assert ooxml.sanitize_link(bad) is None


def test_targets():
    assert ooxml.resolve_target("ppt/slides/s.xml", "../media/./x.png?a#b") == "ppt/media/x.png"
    assert ooxml.resolve_target("ppt/slides/s.xml", "/a\\b") == "a/b"
    for bad in ("../../../x", "http://a"):
        with pytest.raises(ValueError):
            ooxml.resolve_target("ppt/slides/s.xml", bad)
    assert ooxml.rels_part("a/b.xml") == "a/_rels/b.xml.rels" and ooxml.rels_part("b.xml") == "_rels/b.xml.rels"


def test_columns_agree_with_functions(spark):
    targets = ["../media/x.png", "a//b", "/x/../y", "../../../z", "http://q", "..\\m", "x?y", None]
    df = spark.createDataFrame([(t,) for t in targets], "t string").select("t", ooxml.resolve_target_col(F.lit("ppt/slides/s.xml"), F.col("t")).alias("r"))
    for t, r in df.collect():
        try:
            want = ooxml.resolve_target("ppt/slides/s.xml", t) if t is not None else None
        except ValueError:
            want = None
        assert r == want, t
    n = spark.range(1, 18279).select("id", ooxml.column_name_col(F.col("id")).alias("c")).collect()
    assert all(c == ooxml.column_name(i) for i, c in n)
    m = spark.createDataFrame([(x,) for x in ("a.PNG", "b", "c.x.jpeg?q.gif", "d.", "")], "n string").select("n", ooxml.media_type_col(F.col("n")).alias("m")).collect()
    assert all(t == ooxml.media_type(x) for x, t in m)


def test_base64_is_canonical():
    assert ooxml.strict_base64("QQ==") == b"A"
    for bad in ("QR==", "QQ", "Q Q=", "QQ==\n"):
        with pytest.raises(ValueError):
            ooxml.strict_base64(bad)


def test_canonical_json():
    assert ooxml.canonical_json({"b": 1.0, "a": [True, None, "é\n"]}) == '{"a":[true,null,"é\\n"],"b":1}'
    assert ooxml.canonical_hash({}) == hashlib.sha256(b"{}").hexdigest()
    for bad in (math.nan, {1, 2}, b"x"):
        with pytest.raises(ValueError):
            ooxml.canonical_json(bad)
    deep: list = []
    for _ in range(70):
        deep = [deep]
    with pytest.raises(ValueError):
        ooxml.canonical_json(deep)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=12), st.integers(12, 10**7))
def test_scaled_grid(sizes, total):
    out = ooxml.scaled_grid(sizes, total)
    assert sum(out) == total and min(out) >= 1


def test_colors():
    assert color.transformed("808080", [("alpha", 0.5)]) == "#80808080"
    assert color.transformed("FF0000", [("lumMod", 0.5)]) == "#800000"
    assert color.transformed("FF0000", [("lumMod", 0.5), ("lumOff", 0.5)]) == "#FF8080"
    assert color.resolved("schemeClr", {"val": "bg1"}, {"lt1": "FFFFFF"}, {"bg1": "lt1"}) == "FFFFFF"
    assert color.resolved("schemeClr", {"val": "phClr"}, {}, {}, "123456") == "123456"
    assert color.resolved("scrgbClr", {"r": "100%", "g": "0", "b": "50000"}, {}, {}) == "FF0080"
    assert color.resolved("srgbClr", {"val": "xyz"}, {}, {}) is None


def test_paths():
    assert geometry.preset_path("rect", 10, 5) == ("M 0 0 L 10 0 L 10 5 L 0 5 Z", True)
    assert geometry.preset_path("line", 10, 5) == ("M 0 0 L 10 5", True)
    assert geometry.preset_path("no such shape", 10, 5)[1] is False
    assert geometry.preset_path("ellipse", 0, 5)[0].startswith("M 0 0")
    for name in [*geometry.POLYGONS, *geometry.STARS, "roundRect", "snip2DiagRect", "leftRightArrow", "pie", "arc", "chord", "plaque", "mathPlus", "corner", "halfFrame", "frame"]:
        path, exact = geometry.preset_path(name, 30, 20)
        assert exact and path.startswith("M ") and "nan" not in path
    assert geometry.preset_path("roundRect", 10, 10, {"adj": math.nan}) == geometry.preset_path("roundRect", 10, 10)


def test_guides():
    g = geometry.Guides(100, 50, [("a", "*/ w 1 4"), ("b", "+- a hc 0"), ("c", "?: d 1 2"), ("d", "+- d 0 0"), ("e", "pin 0 b 60"), ("f", "at2 1 1")])
    assert (g.get("a"), g.get("b"), g.get("c"), g.get("e"), g.get("f"), g.get("wd2"), g.get("zzz")) == (25, 75, 2, 60, 2700000, 50, 0)


def test_classes_of_outlines():
    from slidelake.sources.package import parse_xml

    def outline(points, end="<a:close/>", size=4):
        at = "".join(f'<a:{"lnTo" if i else "moveTo"}><a:pt x="{x}" y="{y}"/></a:{"lnTo" if i else "moveTo"}>' for i, (x, y) in enumerate(points))
        return geometry.classify(parse_xml(f'<a:custGeom xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:pathLst><a:path w="{size}" h="4">{at}{end}</a:path></a:pathLst></a:custGeom>'.encode())[0])

    assert outline([(0, 0), (2, 0), (2, 1), (0, 1)]) == "rect"
    assert outline([(0, 0), (2, 0), (1, 1)]) == "triangle"
    assert outline([(1, 0), (2, 1), (1, 2), (0, 1)]) == "rhombus"
    assert outline([(0, 0), (3, 0), (4, 1), (1, 1)]) == "parallelogram"
    assert outline([(0, 0), (3, 0), (4, 1), (1, 2)]) == "custom"
    assert outline([(0, 0), (2, 0), (2, 1)], "") == outline([(0, 0), (2, 0), (2, 1)], size=0) == "custom"
