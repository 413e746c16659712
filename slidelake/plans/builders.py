"""Scenes and packages from rows of the driver's tables: what the registered queries parse back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from slidelake.functions.ooxml import xml_filtered
from slidelake.operators.writer import HEAD, NS, package_parts, rels_xml, zip_package

SIZE = {"width": 720, "height": 405}
BOX = {"x": 36, "y": 36, "width": 360, "height": 120}
#: A picture of one dot.
PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000d49444154789c6360606060000000050001a5f645400000000049454e44ae426082")


def lines(text: str) -> list[dict]:
    return [{"children": [{"text": t}] if t else []} for t in xml_filtered(text).split("\n")]


def text_box(text: str, **more: object) -> dict:
    return {"type": "text", "transform": BOX, "paragraphs": lines(text), **more}


def table_of(rows: list[list[str]], **more: object) -> dict:
    n = len(rows[0])
    grid = [60.0] * n
    return {"type": "table", "transform": {"x": 36, "y": 36, "width": 60.0 * n, "height": 20.0 * len(rows)}, "columns": grid, "rows": [{"height": 20.0, "cells": [c if isinstance(c, dict) else {"text": c} for c in r]} for r in rows], **more}


def scene(slides: list[list[dict]], **more: object) -> dict:
    return {"size": SIZE, "slides": [{"elements": s} for s in slides], **more}


def region_deck(row: dict) -> dict:
    return scene([[text_box(name)] for name in row["names"]])


def reversed_deck(row: dict) -> bytes:
    parts = dict(package_parts(region_deck(row)))
    ids = re.findall(r"<p:sldId [^>]*/>", parts["ppt/presentation.xml"])
    parts["ppt/presentation.xml"] = re.sub(r"(<p:sldIdLst>).*(</p:sldIdLst>)", lambda m: m[1] + "".join(reversed(ids)) + m[2], parts["ppt/presentation.xml"])
    return zip_package(list(parts.items()), 1)


def orphan_deck(row: dict) -> bytes:
    """Slides whose key divides by 5 are not declared."""
    parts = dict(package_parts(region_deck(row)))
    for i, k in enumerate(row["keys"], 1):
        if k % 5 == 0:
            parts["[Content_Types].xml"] = re.sub(rf'<Override PartName="/ppt/slides/slide{i}\.xml"[^>]*/>', "", parts["[Content_Types].xml"])
    return zip_package(list(parts.items()), 1)


def pieces(text: str, chars: int, ends: int) -> Iterator[str]:
    """Pieces of at most so many characters and line ends; they join to the text. An empty text is one piece."""
    at = 0
    while True:
        to = min(len(text), at + chars)
        if text.count("\n", at, to) > ends:
            to = at
            for _ in range(ends):
                to = text.index("\n", to) + 1
        yield text[at:to]
        if (at := to) >= len(text):
            return


def text_deck(row: dict) -> dict:
    return scene([[text_box(t)] for t in row["texts"]])


def kinds_deck(row: dict) -> dict:
    chart = {"type": "chart", "transform": BOX, "chartType": "bar", "series": [{"name": "s", "categories": ["a"], "values": [1]}]}
    return scene([[text_box(n), {"type": "shape", "transform": BOX, "geometry": "ellipse", "fillColor": "#4472C4"}, table_of([[n]]), chart] for n in row["names"]])


def runs_deck(row: dict) -> dict:
    return scene([[{"type": "text", "transform": BOX, "paragraphs": [{"children": [{"text": str(k), "properties": {"bold": b}} for k, b in zip(row["keys"], row["bold"], strict=True)]}]}]])


def tables_deck(row: dict) -> dict:
    """A slide with a table of the columns line, part and quantity. Null is an empty cell."""
    return scene([[table_of([[{"text": x or ""} for x in r] for r in zip(row["line"], row["part"], row["quantity"], strict=True)])]])


def merged_deck(row: dict) -> dict:
    """A slide with a table of the columns line and part, in which the rows that follow each other with one key have one first cell."""
    rows = []
    for _, group in groupby(zip(row["key"], row["line"], row["part"], strict=True), lambda x: x[0]):
        (_, line, part), *more = group
        rows.append([{"text": line, "rowSpan": 1 + len(more)} if more else {"text": line}, {"text": part or ""}])
        rows += [[{"vMerge": True}, {"text": x[2] or ""}] for x in more]
    return scene([[table_of(rows)]])


STYLE = '<a:tblStyleLst xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:tblStyle styleId="{S}" styleName="s">' + "".join(f'<a:{k}><a:tcStyle><a:fill><a:solidFill><a:srgbClr val="{c}"/></a:solidFill></a:fill></a:tcStyle></a:{k}>' for k, c in (("wholeTbl", "111111"), ("band1H", "222222"), ("band2H", "333333"), ("firstRow", "444444"), ("lastRow", "555555"))) + "</a:tblStyle></a:tblStyleLst>"


def styled_deck(row: dict) -> bytes:
    parts = dict(package_parts(scene([[table_of([[x] for x in row["names"]])]])))
    slide = "ppt/slides/slide1.xml"
    parts[slide] = parts[slide].replace("<a:tblPr/>", '<a:tblPr firstRow="1" lastRow="1" bandRow="1"><a:tableStyleId>{S}</a:tableStyleId></a:tblPr>')
    parts["ppt/tableStyles.xml"] = HEAD + STYLE
    return zip_package(list(parts.items()), 1)


def chart_deck(row: dict) -> dict:
    series = [{"name": "orders", "color": row.get("color"), "categories": row["categories"], "values": row["values"]}]
    return scene([[{"type": "chart", "transform": BOX, "chartType": row.get("kind") or "bar", "series": series}]])


def sized_deck(row: dict) -> dict:
    """A group whose children's space is twice its own size, and in it a box and a group with a box."""
    shapes = []
    for s in row["sizes"]:
        inner = {"type": "shape", "transform": {"x": s, "y": s, "width": 2 * s, "height": s}}
        nested = {"type": "group", "transform": {"x": 100, "y": 100, "width": 100, "height": 100}, "childSpace": {"x": 0, "y": 0, "width": 200, "height": 200}, "elements": [inner]}
        shapes.append([{"type": "group", "transform": {"x": 10, "y": 20, "width": 200, "height": 100}, "childSpace": {"x": 0, "y": 0, "width": 400, "height": 200}, "elements": [inner, nested]}])
    return scene(shapes)


def _placeholder(kind: str, props: str, body: str = "<a:bodyPr/><a:lstStyle/><a:p/>") -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="9" name="ph"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr>{props}</p:spPr><p:txBody>{body}</p:txBody></p:sp>'


def _xfrm(x: int) -> str:
    return f'<a:xfrm><a:off x="{x * 12700}" y="0"/><a:ext cx="{x * 12700}" cy="12700"/></a:xfrm>'


def inherited_deck(row: dict) -> bytes:
    """A slide for each key. Key modulo 3: position, fill and font size stand on the slide (0), come from the layout's body (1), or from the master's title (2); modulo 4 at 3: the slide says no fill."""
    fill = lambda c: f'<a:solidFill><a:srgbClr val="{c}"/></a:solidFill>'
    size = lambda s: f'<a:bodyPr/><a:lstStyle><a:lvl1pPr><a:defRPr sz="{s}"/></a:lvl1pPr></a:lstStyle><a:p/>'
    parts = dict(package_parts(scene([[] for _ in row["keys"]])))
    layout, master = "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml"
    parts[layout] = parts[layout].replace("</p:spTree>", _placeholder("body", _xfrm(200) + fill("00FF00"), size(2400)) + "</p:spTree>")
    parts[master] = parts[master].replace("</p:spTree>", _placeholder("title", _xfrm(300) + fill("0000FF"), size(3200)) + "</p:spTree>")
    for i, k in enumerate(row["keys"], 1):
        own, none = k % 3 == 0, k % 4 == 3
        props = (_xfrm(100) if own else "") + ("<a:noFill/>" if none else fill("FF0000") if own else "")
        run = f'<a:bodyPr/><a:p><a:r><a:rPr{" sz=" + chr(34) + "1100" + chr(34) if own else ""}/><a:t>{k}</a:t></a:r></a:p>'
        slide = f"ppt/slides/slide{i}.xml"
        parts[slide] = parts[slide].replace("</p:spTree>", _placeholder("title" if k % 3 == 2 else "body", props, run) + "</p:spTree>")
    return zip_package(list(parts.items()), 1)


def notes_deck(row: dict) -> bytes:
    parts = dict(package_parts(scene([[] for _ in row["names"]])))
    for i, name in enumerate(row["names"], 1):
        rel = f"ppt/slides/_rels/slide{i}.xml.rels"
        parts[rel] = rels_xml([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "notesSlide", f"../notesSlides/notesSlide{i}.xml")])
        parts[f"ppt/notesSlides/notesSlide{i}.xml"] = f"{HEAD}<p:notes {NS}><p:cSld><p:spTree>{_placeholder('body', '', f'<a:bodyPr/><a:p><a:r><a:t>{name}</a:t></a:r></a:p>')}</p:spTree></p:cSld></p:notes>"
    return zip_package(list(parts.items()), 1)


def transition_deck(row: dict) -> bytes:
    """Key modulo 3: a fade at medium speed on the slide, a push from the left for 1234 ms in an alternative, or what the layout says."""
    parts = dict(package_parts(scene([[] for _ in row["keys"]])))
    layout = "ppt/slideLayouts/slideLayout1.xml"
    parts[layout] = parts[layout].replace("</p:sldLayout>", '<p:transition spd="fast" advTm="900"><p:wipe dir="u"/></p:transition></p:sldLayout>')
    for i, k in enumerate(row["keys"], 1):
        t = ['<p:transition spd="med"><p:fade/></p:transition>', '<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><mc:Choice xmlns:p14="http://schemas.microsoft.com/office/powerpoint/2010/main" Requires="p14"><p:transition p14:dur="1234"><p:push dir="l"/></p:transition></mc:Choice></mc:AlternateContent>', ""][k % 3]
        slide = f"ppt/slides/slide{i}.xml"
        parts[slide] = parts[slide].replace("</p:sld>", t + "</p:sld>")
    return zip_package(list(parts.items()), 1)


def faulty_deck(row: dict) -> bytes:
    """Key modulo 4: sound, a page size that is no number, a relationship out of the package, a slide that is no XML."""
    parts = dict(package_parts(scene([[text_box("x")]])))
    kind = row["key"] % 4
    if kind == 1:
        parts["ppt/presentation.xml"] = re.sub(r'<p:sldSz [^>]*/>', '<p:sldSz cx="wide" cy="1"/>', parts["ppt/presentation.xml"])
    elif kind == 2:
        parts["ppt/slides/_rels/slide1.xml.rels"] = rels_xml([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "image", "../../../../x.png")])
    elif kind == 3:
        parts["ppt/slides/slide1.xml"] = "<p:sld"
    return zip_package(list(parts.items()), 1)


def picture_deck(row: dict) -> dict:
    media = [{"key": "m", "mimeType": "image/png", "data": PNG}]
    return scene([[{"type": "image", "transform": BOX, "mediaKey": "m", "crop": {"left": k % 7, "top": k % 5 / 2}}] for k in row["keys"]], media=media)


def colored_deck(row: dict) -> bytes:
    """Boxes filled with accent 1, darkened by the key's share, through the layout's colour map."""
    parts = dict(package_parts(scene([[] for _ in row["keys"]])))
    for i, k in enumerate(row["keys"], 1):
        slide = f"ppt/slides/slide{i}.xml"
        fill = f'<a:solidFill><a:schemeClr val="{["accent1", "bg1", "tx1"][k % 3]}"><a:alpha val="{k % 2 * 50000 + 50000}"/></a:schemeClr></a:solidFill>'
        parts[slide] = parts[slide].replace("</p:spTree>", f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="b"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{_xfrm(50)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom>{fill}</p:spPr></p:sp></p:spTree>')
    return zip_package(list(parts.items()), 1)


