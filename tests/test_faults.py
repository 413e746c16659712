"""No attribute, scene or operation may raise anything but the errors that are declared."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slidelake.operators import roundtrip
from slidelake.operators.validate import validate_scene
from slidelake.operators.writer import create_deck
from slidelake.plans import builders as B
from slidelake.plans import rules as R
from slidelake.sources.deck import parse_deck

VALUES = st.one_of(st.sampled_from(["", "-", "²", "٣", "1e999", "nan", "inf", "-0", "0x10", "99999999999999999999", "2147483648", "1.5", "%", "100%", " 5", "true"]), st.integers(-(2**70), 2**70).map(str))


@settings(max_examples=150, deadline=None)
@given(VALUES, VALUES, VALUES)
def test_attribute_values(a, b, c):
    a, b, c = (x.replace("<", "") for x in (a, b, c))
    looks = f'<a:gradFill><a:gsLst><a:gs pos="{a}"><a:hslClr hue="{b}" sat="{c}" lum="{a}"><a:lumMod val="{b}"/><a:alpha val="{c}"/></a:hslClr></a:gs></a:gsLst><a:lin ang="{a}"/></a:gradFill><a:ln w="{b}"/><a:effectLst><a:outerShdw dist="{a}" dir="{b}" blurRad="{c}"/></a:effectLst>'
    text = R.body(f'<a:p><a:pPr lvl="{a}" marL="{b}" indent="{c}"><a:lnSpc><a:spcPct val="{a}"/></a:lnSpc><a:spcBef><a:spcPts val="{b}"/></a:spcBef></a:pPr>{R.run("x", f"<a:rPr sz={chr(34)}{c}{chr(34)} spc={chr(34)}{a}{chr(34)} baseline={chr(34)}{b}{chr(34)}/>")}</a:p>', f'<a:bodyPr lIns="{a}"><a:normAutofit fontScale="{b}"/></a:bodyPr>')
    outline = f'<a:custGeom><a:gdLst><a:gd name="g" fmla="*/ {a or 0} {b or 0} {c or 0}"/></a:gdLst><a:pathLst><a:path w="{a}" h="{b}"><a:moveTo><a:pt x="g" y="{c}"/></a:moveTo><a:arcTo wR="{a}" hR="{b}" stAng="{c}" swAng="{a}"/></a:path></a:pathLst></a:custGeom>'
    shapes = R.shape(1, looks, text) + R.shape(2, outline=outline) + R.shape(3, xfrm=f'<a:xfrm rot="{a}"><a:off x="{b}" y="{c}"/><a:ext cx="{a}" cy="{b}"/></a:xfrm>') + R.shape(4, outline=f'<a:prstGeom prst="star5"><a:avLst><a:gd name="adj" fmla="val {a or 0}"/></a:avLst></a:prstGeom>')
    row = parse_deck(R.changed(B.scene([[]]), {R.SLIDE.format(1): lambda s: s.replace("</p:spTree>", shapes + "</p:spTree>"), R.MAIN: lambda s: s.replace('cx="9144000"', f'cx="{a}"')}))
    assert row["status"] == "ok", row["message"]


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.floats(), st.integers(), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["key", "type", "text", "transform", "x", "width", "elements", "cells", "kind"]), x, max_size=3)), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["replace-text", "set-transform", "other"]), st.sampled_from(["slide-1-element-1", "slide-1-element-1-run-1", "none"]), JSON)
def test_operations(kind, key, value):
    snapshot = roundtrip.read_snapshot(DECK)
    try:
        s = roundtrip.edited(snapshot, [(kind, key, value)])
        assert parse_deck(roundtrip.restore(s))["status"] == "ok"
    except roundtrip.EditError:
        pass


DECK = create_deck(B.scene([[B.text_box("text")]]))


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_snapshots(value):
    with pytest.raises(roundtrip.EditError):
        roundtrip.restore(value)


def test_written_packages_read_back():
    media = [{"key": "m", "mimeType": "image/png", "data": B.PNG}]
    chart = {"type": "chart", "transform": B.BOX, "chartType": "line", "marker": True, "series": [{"name": "s", "categories": ["a", "b"], "values": [1, 2.5]}]}
    group = {"type": "group", "transform": B.BOX, "childSpace": B.BOX, "elements": [B.text_box("in"), {"type": "shape", "transform": B.BOX | {"rotation": 45}, "geometry": "ellipse"}]}
    assert create_deck(B.scene([[B.text_box("a\nb"), B.table_of([["1", "2"], ["3", "4"]]), chart, {"type": "image", "transform": B.BOX, "mediaKey": "m"}, group]], media=media))


def test_what_cannot_be_written_is_refused():
    whole = B.scene([[]], themes=[{"key": "t", "name": "t"}], masters=[{"key": "m", "name": "m", "themeKey": "t", "elements": []}], layouts=[{"key": "l", "name": "l", "masterKey": "m", "elements": [B.text_box("lost")]}]) | {"slides": [{"layoutKey": "l", "elements": []}]}
    assert validate_scene(whole, "scene") == []
    with pytest.raises(ValueError, match="unsupported-feature"):
        create_deck(whole)
    with pytest.raises(ValueError, match="unsupported-feature"):
        create_deck(B.scene([[B.text_box("x", placeholder={"role": "slide-instance"})]]))
    assert [i["code"] for i in validate_scene(B.scene([[B.table_of([["x"]])]]), "create-text")] == ["unsupported-feature"]
