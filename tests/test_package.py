import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slidelake.operators.writer import package_parts, zip_package
from slidelake.plans import builders as B
from slidelake.sources.deck import Options, parse_deck
from slidelake.sources.package import Limits, PackageError, open_package, parse_xml


def parts(*slides):
    return dict(package_parts(B.scene(list(slides) or [[B.text_box("x")]])))


def packed(p):
    return zip_package(list(p.items()), 1)


def test_whitespace_and_order():
    root, n = parse_xml(b"<a><b> </b> <c>x</c>\n</a>")
    assert [(c.tag, c.text) for c in root.children] == [("b", " "), ("c", "x")]
    assert n == 3 and [c.order for c in root.children] == [1, 2] and root.order == 3


def test_namespaces():
    root, _ = parse_xml(b'<x:sld xmlns:x="http://purl.oclc.org/ooxml/presentationml/main" xmlns="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:a="urn:other"><t id="1"/><a:t/></x:sld>')
    assert root.tag == "p:sld" and [c.tag for c in root.children] == ["a:t", "ns_a:t"] and root.children[0].attrs == {"id": "1"}


@pytest.mark.parametrize(
    "raw",
    [b"<!DOCTYPE a><a/>", b"<a", b"<a>x<b/></a>", b"\xff\xfea", b"<a>\xff</a>", b'<a xmlns:p="urn:q" xmlns:q="urn:q" p:x="1" p:x="2"/>', "<é/>".encode()],
)
def test_bad_xml(raw):
    with pytest.raises(PackageError) as e:
        parse_xml(raw)
    assert e.value.code == "invalid-xml"


def test_utf16():
    assert parse_xml('<?xml version="1.0" encoding="UTF-16"?><a>é</a>'.encode("utf-16"))[0].text == "é"


def test_limits_are_strict():
    raw = packed(parts())
    n = len(open_package(raw).names)
    assert open_package(raw, Limits(entries=n, input_bytes=len(raw)))
    for limits in (Limits(entries=n - 1), Limits(input_bytes=len(raw) - 1), Limits(expanded_bytes=100), Limits(part_bytes=10)):
        with pytest.raises(PackageError) as e:
            open_package(raw, limits)
        assert e.value.code == "resource-limit"
    with pytest.raises(PackageError):
        parse_xml(b"<a><b><c/></b></a>", Limits(xml_depth=2))
    with pytest.raises(PackageError):
        parse_xml(b"<a><b/><b/></a>", Limits(xml_nodes=2))
    assert parse_deck(raw, "", Options(limits=Limits(package_nodes=5)))["code"] == "resource-limit"
    with pytest.raises(ValueError):
        Limits(slides=0)


def test_a_header_that_lies():
    raw = bytearray(packed({"a.xml": "<a>" + "x" * 5000 + "</a>"}))
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the declared size
    p = open_package(bytes(raw), Limits(xml_bytes=1000))
    try:
        assert p.xml("a.xml") is None
    except PackageError as e:
        assert e.code == "resource-limit"


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200))
def test_no_bytes_crash(raw):
    assert parse_deck(raw)["status"] == "failed"


def test_missing_parts_are_diagnostics():
    p = parts()
    del p["ppt/slides/slide1.xml"]
    row = parse_deck(packed(p))
    assert row["status"] == "ok" and {d["code"] for d in row["diagnostics"]} == {"missing-part"}
    assert parse_deck(packed(p), "", Options(strict=True))["code"] == "missing-part"


def test_shape_or_text():
    """A rectangle with a role and text is text; without either it is a shape."""
    p = parts([B.text_box("t"), B.text_box(""), {"type": "shape", "transform": B.BOX, "fillColor": "#112233"}, {"type": "shape", "transform": B.BOX, "geometry": "star5"}])
    got = [e["type"] for e in parse_deck(packed(p))["elements"]]
    assert got == ["text", "text", "shape", "shape"]


def test_dash_without_entry_is_solid():
    p = parts([{"type": "shape", "transform": B.BOX, "lineColor": "#112233", "lineWidth": 2}])
    p["ppt/slides/slide1.xml"] = p["ppt/slides/slide1.xml"].replace("</a:ln>", '<a:prstDash val="lgDashDot"/></a:ln>')
    e = parse_deck(packed(p))["elements"][0]
    assert (e["border_color"], e["border_width"], e["border_type"], e["border_dash"]) == ("#112233", 2.0, "solid", "0")


def test_background_that_cannot_resolve_does_not_fall_through():
    p = parts([])
    p["ppt/slides/slide1.xml"] = p["ppt/slides/slide1.xml"].replace("<p:cSld>", '<p:cSld><p:bg><p:bgPr><a:solidFill><a:schemeClr val="nope"/></a:solidFill></p:bgPr></p:bg>')
    assert parse_deck(packed(p))["slides"][0]["background"] == "#fff"


def test_scatter():
    p = parts([{"type": "chart", "transform": B.BOX, "chartType": "bar", "series": [{"name": "s", "categories": ["a"], "values": [1]}]}])
    p["ppt/charts/chart1.xml"] = '<c:chartSpace><c:chart><c:plotArea><c:scatterChart><c:ser><c:xVal><c:numRef><c:numCache><c:pt idx="0"><c:v>1</c:v></c:pt></c:numCache></c:numRef></c:xVal><c:yVal><c:numRef><c:numCache><c:pt idx="0"><c:v>x</c:v></c:pt></c:numCache></c:numRef></c:yVal></c:ser></c:scatterChart></c:plotArea></c:chart></c:chartSpace>'
    assert [(x["row_no"], x["v"]) for x in parse_deck(packed(p))["chart_xy"]] == [(0, 1.0), (1, 0.0)]


def test_math():
    m = '<mc:AlternateContent><mc:Choice><p:sp><p:nvSpPr><p:cNvPr id="5" name="m"/></p:nvSpPr><p:spPr/><p:txBody><a:p><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:rad><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad></m:den></m:f></m:oMath></a:p></p:txBody></p:sp></mc:Choice></mc:AlternateContent>'
    p = parts([])
    p["ppt/slides/slide1.xml"] = p["ppt/slides/slide1.xml"].replace("</p:spTree>", m + "</p:spTree>")
    e = parse_deck(packed(p))["elements"][0]
    assert (e["type"], e["latex"]) == ("math", "\\frac{1}{\\sqrt{x}}")


def test_diagram():
    p = parts([])
    frame = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="d"/></p:nvGraphicFramePr><p:xfrm><a:off x="127000" y="0"/><a:ext cx="12700" cy="12700"/></p:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/diagram"><dgm:relIds xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram" r:dm="rId5"/></a:graphicData></a:graphic></p:graphicFrame>'
    p["ppt/slides/slide1.xml"] = p["ppt/slides/slide1.xml"].replace("</p:spTree>", frame + "</p:spTree>")
    rel = "ppt/slides/_rels/slide1.xml.rels"
    rels = '<Relationship Id="rId5" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/diagramData" Target="../diagrams/data1.xml"/><Relationship Id="rId6" Type="x" Target="../diagrams/drawing1.xml"/>'
    p[rel] = p[rel].replace("</Relationships>", rels + "</Relationships>")
    p["ppt/diagrams/data1.xml"] = '<dgm:dataModel xmlns:dsp="http://schemas.microsoft.com/office/drawing/2008/diagram"><dgm:ptLst><dgm:pt><dgm:t><a:p><a:r><a:t>one</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt/></dgm:ptLst><dgm:extLst><a:ext><dsp:dataModelExt relId="rId6"/></a:ext></dgm:extLst></dgm:dataModel>'
    p["ppt/diagrams/drawing1.xml"] = '<dsp:drawing><dsp:spTree><dsp:sp><dsp:nvSpPr><dsp:cNvPr id="1" name="q"/></dsp:nvSpPr><dsp:spPr><a:xfrm><a:off x="12700" y="0"/><a:ext cx="25400" cy="12700"/></a:xfrm><a:prstGeom prst="ellipse"/></dsp:spPr></dsp:sp></dsp:spTree></dsp:drawing>'
    row = parse_deck(packed(p))
    assert [t["text"] for t in row["diagram_text"]] == ["one"]
    assert [(e["type"], e["origin"], e["left"], e["width"]) for e in row["elements"]] == [("diagram", "slide", 10.0, 1.0), ("shape", "diagram", 11.0, 2.0)]


def test_archives_are_deterministic():
    assert packed(parts()) == packed(parts())
    with zipfile.ZipFile(io.BytesIO(packed(parts()))) as z:
        assert z.infolist()[0].filename == "[Content_Types].xml" and z.infolist()[0].date_time == (1980, 1, 1, 0, 0, 0)
