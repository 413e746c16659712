import copy

import pytest

from slidelake.operators import render, roundtrip as R
from slidelake.operators.validate import validate_scene
from slidelake.operators.writer import create_deck, package_parts, zip_package
from slidelake.plans import builders as B
from slidelake.sources.package import PackageError

T = {"x": 10, "y": 20, "width": 200, "height": 100}
SCENE = B.scene([[B.text_box("Hi <b>"), B.table_of([["a", "b"], ["c", "d"]]), {"type": "group", "transform": T, "childSpace": {"x": 0, "y": 0, "width": 400, "height": 200}, "elements": [{"type": "shape", "transform": {"x": 40, "y": 20, "width": 40, "height": 20}}]}]])


@pytest.fixture(scope="module")
def raw():
    return create_deck(SCENE)


def test_same_bytes(raw):
    s = R.read_snapshot(raw)
    assert R.restore(s) == raw and s["supportProfile"]["level"] == "R0"
    assert R.from_json(R.to_json(s)) == s


def test_edits(raw):
    s = R.replace_text(R.read_snapshot(raw), "slide-1-element-1-run-1", "  new & old ")
    s = R.replace_text(s, "slide-1-element-2-row-2-cell-1-run-1", "C!")
    s = R.set_transform(s, "slide-1-element-2", {"x": 30, "width": 150})
    s = R.set_transform(s, "slide-1-element-3", {"x": 30, "width": 100, "rotation": 45.0, "flipHorizontal": True})
    doc = {e["key"]: e for e in R.read_snapshot(R.restore(s))["document"]}
    assert doc["slide-1-element-1"]["runs"][0]["text"] == "  new & old "
    assert [r["text"] for r in doc["slide-1-element-2"]["runs"]] == ["a", "b", "C!", "d"]
    assert doc["slide-1-element-3-element-1"]["transform"]["width"] == 10.0
    assert s["document"][0]["runs"][0]["text"] == "Hi <b>"  # the preview stays at the source


@pytest.mark.parametrize(("key", "value", "code"), [("slide-9-element-1-run-1", "x", "missing-target"), ("slide-1-element-1-run-1", "Hi <b>", "no-change"), ("slide-1-element-1-run-1", "\x01", "invalid-text")])
def test_refused_texts(raw, key, value, code):
    with pytest.raises(R.EditError) as e:
        R.replace_text(R.read_snapshot(raw), key, value)
    assert e.value.code == code


def test_one_operation_a_target(raw):
    s = R.replace_text(R.read_snapshot(raw), "slide-1-element-1-run-1", "x")
    with pytest.raises(R.EditError):
        R.replace_text(s, "slide-1-element-1-run-1", "y")


def test_tampering_is_found(raw):
    s = R.replace_text(R.read_snapshot(raw), "slide-1-element-1-run-1", "x")
    for path, value in ((("source", "sha256"), "0" * 64), (("source", "packageBase64"), "QQ=="), (("operations",), []), (("document",), [])):
        bad = copy.deepcopy(s)
        at = bad
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(R.EditError):
            R.restore(bad)


def test_signed_packages_are_not_edited():
    parts = [*package_parts(SCENE), ("_xmlsignatures/origin.sigs", "x")]
    s = R.replace_text(R.read_snapshot(zip_package(parts)), "slide-1-element-1-run-1", "x")
    with pytest.raises(R.EditError) as e:
        R.restore(s)
    assert e.value.code == "unsupported-package"


def test_issues():
    def codes(*elements, **more):
        return [i["code"] for i in validate_scene(B.scene([list(elements)], **more))]

    box = {"type": "shape", "transform": T}
    assert codes(box) == []
    assert codes(box | {"key": "a"}, box | {"key": "a"}) == ["duplicate-key"]
    assert codes(box | {"key": "-"}) == ["invalid-key"]
    assert codes(box | {"transform": T | {"x": float("nan")}}) == ["invalid-number"]
    assert codes(B.text_box("a") | {"paragraphs": [{"children": [{"text": "\x00"}]}]}) == ["invalid-text"]
    assert codes({"type": "image", "transform": T, "mediaKey": "m"}) == ["missing-reference"]
    assert codes(box, media=[{"key": "m", "mimeType": "image/png", "data": b"x"}]) == ["invalid-media"]
    assert codes({"type": "video", "transform": T}) == ["unsupported-element"]
    assert codes(box, extra=1) == ["unknown-key"]
    chart = {"type": "chart", "transform": T, "chartType": "pie", "series": [{"categories": ["a"], "values": [1]}] * 2}
    assert codes(chart) == ["invalid-value"]
    table = B.table_of([["a", "b"], ["c", "d"]])
    table["rows"][0]["cells"][0]["colSpan"] = 2
    assert codes(table) == ["invalid-merge"]
    table["rows"][0]["cells"][1]["hMerge"] = True
    assert codes(table) == []
    with pytest.raises(ValueError):
        create_deck(B.scene([[box | {"fillColor": "red"}]]))


def test_pictures(raw):
    out = render.render_deck(raw, render.Request((1,), 2.0))
    assert out[0]["width"] == 1440 and out[0]["data"].startswith("<svg ") and "<script" not in out[0]["data"]
    assert out == render.render_deck(raw, render.Request((1,), 2.0))
    assert "Hi &lt;b&gt;" in out[0]["data"]
    for bad in (render.Request((2,)), render.Request((1, 1)), render.Request(None, 9)):
        with pytest.raises(render.RenderError):
            render.render_deck(raw, bad)
    with pytest.raises(PackageError):
        render.render_deck(b"x")
