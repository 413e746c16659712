import json

from slidelake.__main__ import main
from slidelake.operators.writer import create_deck, package_parts, zip_package
from slidelake.plans import builders as B
from slidelake.sources.deck import parse_deck


def test_commands(tmp_path, capsys):
    deck, snap, edited, out = (tmp_path / x for x in ("a.pptx", "a.json", "b.json", "b.pptx"))
    deck.write_bytes(create_deck(B.scene([[B.text_box("old")]])))
    assert main([str(deck)]) == 0 and json.loads(capsys.readouterr().out)["elements"][0]["plain_text"] == "old"
    assert main(["convert", str(deck), "--document-only", "--pretty", "--image-mode", "base64"]) == 0 and "status" not in json.loads(capsys.readouterr().out)
    assert main(["snapshot", str(deck), "-o", str(snap)]) == 0
    assert main(["edit-text", str(snap), "--output", str(edited), "--target", "slide-1-element-1-run-1", "--value=-new"]) == 0
    assert main(["restore", str(edited), "-o", str(out)]) == 0 and parse_deck(out.read_bytes())["elements"][0]["plain_text"] == "-new"
    assert main(["transform-text", str(snap), "-o", str(edited), "--target", "slide-1-element-1", "--x=-10", "--flip-horizontal", "true"]) == 0
    assert main(["restore", str(edited), "-o", str(out)]) == 0 and [parse_deck(out.read_bytes())["elements"][0][k] for k in ("left", "flip_h")] == [-10.0, True]
    assert main(["render", str(deck), "-o", str(tmp_path / "svg")]) == 0
    manifest = json.loads((tmp_path / "svg/manifest.json").read_text())
    assert manifest[0]["file"] == "slide-1.svg" and manifest[0]["bytes"] == (tmp_path / "svg/slide-1.svg").stat().st_size
    assert main(["restore", str(deck), "-o", str(out)]) == 1 and json.loads(capsys.readouterr().err)["error"]


def test_picture_effects_and_line_ends():
    media = [{"key": "m", "mimeType": "image/png", "data": B.PNG}]
    parts = dict(package_parts(B.scene([[{"type": "image", "transform": B.BOX, "mediaKey": "m"}, {"type": "shape", "transform": B.BOX, "lineColor": "#000000", "lineWidth": 1}]], media=media)))
    slide = "ppt/slides/slide1.xml"
    effects = '<a:alphaModFix amt="40000"/><a:extLst><a:ext><a14:imgEffect><a14:saturation sat="150000"/></a14:imgEffect><a14:imgEffect><a14:sharpenSoften amount="-25000"/></a14:imgEffect></a:ext></a:extLst>'
    parts[slide] = parts[slide].replace('<a:blip r:embed="rId2"/>', f'<a:blip r:embed="rId2">{effects}</a:blip>').replace("</a:ln>", '<a:headEnd type="arrow"/><a:tailEnd type="none"/></a:ln>')
    picture, shape = parse_deck(zip_package(list(parts.items())))["elements"]
    assert (picture["opacity"], picture["saturation"], picture["soften"]) == (0.4, 1.5, 0.25)
    assert (shape["head_end"], shape["tail_end"]) == ("arrow", None)


def test_standard_input(tmp_path, capsys, monkeypatch):
    import io
    import sys
    from types import SimpleNamespace

    import pytest

    raw = create_deck(B.scene([[B.text_box("piped")]]))
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(raw)))
    assert main(["convert", "-", "--format", "pptx"]) == 0 and json.loads(capsys.readouterr().out)["elements"][0]["plain_text"] == "piped"
    with pytest.raises(SystemExit):
        main(["convert", "-"])
