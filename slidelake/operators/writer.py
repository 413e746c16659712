"""Creating packages from scenes: parts in a fixed order, a deterministic archive, and a check by reading it back.

A scene is plain data: size, slides, optional media; elements of type text, shape, image, table, chart or group; sizes in points.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slidelake.functions.ooxml import ANGLE_UNITS, EMU_PER_POINT, FONT_UNITS, MEDIA_TYPES, column_name, degrees, emu_to_points, escape_xml, js_number, needs_preserve, sha256, units

# Namespaces and types of the parts that are written.
_O = "http://schemas.openxmlformats.org/"
NS = f'xmlns:a="{_O}drawingml/2006/main" xmlns:r="{_O}officeDocument/2006/relationships" xmlns:p="{_O}presentationml/2006/main"'
REL = _O + "officeDocument/2006/relationships/"
CT = "application/vnd.openxmlformats-officedocument."
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
EMPTY_TREE = '<p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/><a:chOff x="0" y="0"/><a:chExt cx="0" cy="0"/></a:xfrm></p:grpSpPr>'
CLR_MAP = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'
THEME_COLORS = (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "44546A"), ("lt2", "E7E6E6"), ("accent1", "4472C4"), ("accent2", "ED7D31"), ("accent3", "A5A5A5"), ("accent4", "FFC000"), ("accent5", "5B9BD5"), ("accent6", "70AD47"), ("hlink", "0563C1"), ("folHlink", "954F72"))
# End of fixed values.


def emu(x: float) -> int:
    return units(x, EMU_PER_POINT)


def tag(name: str, attrs: dict[str, object] | None = None, *inner: str) -> str:
    a = "".join(f" {k}={quoteattr(str(v))}" for k, v in (attrs or {}).items() if v is not None)
    return f"<{name}{a}>{''.join(inner)}</{name}>" if inner else f"<{name}{a}/>"


def xfrm(t: dict, name: str = "a:xfrm", child: dict | None = None) -> str:
    a = {"rot": units(t["rotation"], ANGLE_UNITS) if t.get("rotation") else None, "flipH": "1" if t.get("flipHorizontal") else None, "flipV": "1" if t.get("flipVertical") else None}
    inner = [tag("a:off", {"x": emu(t["x"]), "y": emu(t["y"])}), tag("a:ext", {"cx": emu(t["width"]), "cy": emu(t["height"])})]
    if child:
        inner += [tag("a:chOff", {"x": emu(child["x"]), "y": emu(child["y"])}), tag("a:chExt", {"cx": emu(child["width"]), "cy": emu(child["height"])})]
    return tag(name, a, *inner)


def solid(color: str | None) -> str:
    return tag("a:solidFill", None, tag("a:srgbClr", {"val": color.lstrip("#")})) if color else ""


#: Text that is written as it stands.
_AS_IS = re.compile(r"[0-9A-Za-z.,:;+\-]*\Z")


def text_node(text: str) -> str:
    if _AS_IS.match(text):
        return f"<a:t>{text}</a:t>"
    return f"<a:t{' xml:space=' + chr(34) + 'preserve' + chr(34) if needs_preserve(text) else ''}>{escape_xml(text)}</a:t>"


def run_props(p: dict | None, name: str = "a:rPr") -> str:
    p = p or {}
    a = {"lang": p.get("language"), "sz": units(p["fontSize"], FONT_UNITS) if p.get("fontSize") else None, "b": None if p.get("bold") is None else int(p["bold"]), "i": None if p.get("italic") is None else int(p["italic"]), "u": "sng" if p.get("underline") else None, "strike": "sngStrike" if p.get("strike") else None}
    return tag(name, a, *([solid(p["color"])] if p.get("color") else []), *([tag("a:latin", {"typeface": p["fontFamily"]})] if p.get("fontFamily") else []))


def paragraph(p: dict) -> str:
    out = []
    if p.get("align") or p.get("level"):
        out.append(tag("a:pPr", {"lvl": p.get("level"), "algn": {"left": "l", "center": "ctr", "right": "r", "justify": "just"}.get(p.get("align") or "")}))
    for c in p.get("children") or []:
        kind = c.get("type", "run")
        if kind == "break":
            out.append(tag("a:br", None, run_props(c.get("properties"))))
        elif kind == "field":
            out.append(tag("a:fld", {"id": c.get("id", "{00000000-0000-4000-8000-000000000000}"), "type": c.get("fieldType", "slidenum")}, run_props(c.get("properties")), text_node(c.get("text", ""))))
        else:
            out.append(tag("a:r", None, run_props(c.get("properties")), text_node(c.get("text", ""))))
    if p.get("endProperties"):
        out.append(run_props(p["endProperties"], "a:endParaRPr"))
    return tag("a:p", None, *out) if out else "<a:p/>"


def body(name: str, b: dict | None, paragraphs: list[dict]) -> str:
    b = b or {}
    fit = {"shape": "<a:spAutoFit/>", "text": "<a:normAutofit/>", "none": "<a:noAutofit/>"}.get(b.get("autoFit") or "", "")
    props = tag("a:bodyPr", {"wrap": None if b.get("wrap") is None else "square" if b["wrap"] else "none", "anchor": {"top": "t", "middle": "ctr", "bottom": "b"}.get(b.get("anchor") or ""), "vert": "vert" if b.get("vertical") else None}, *([fit] if fit else []))
    return tag(name, None, props, "<a:lstStyle/>", *(map(paragraph, paragraphs) if paragraphs else ["<a:p/>"]))


#: Of a cell that has no more than a line of text and spans: what stands before and behind the text, or without any.
PLAIN_CELL = frozenset({"text", "rowSpan", "colSpan", "hMerge", "vMerge"})
CELL_BEFORE, CELL_BEHIND = f"{body('a:txBody', None, [{'children': [{'text': 'x'}]}])}<a:tcPr/></a:tc>".split(text_node("x"))
CELL_EMPTY = f"{body('a:txBody', None, [{'children': []}])}<a:tcPr/></a:tc>"


@lru_cache(4096)
def cell_start(rows: int | None, columns: int | None, h_merge: bool, v_merge: bool) -> str:
    return tag("a:tc", {"rowSpan": rows, "gridSpan": columns, "hMerge": "1" if h_merge else None, "vMerge": "1" if v_merge else None}, "")[: -len("</a:tc>")]


class SlideParts:
    """Writes a slide's elements; numbers shapes depth first from 2, and collects relationships, charts and media."""

    def __init__(self, charts: list[str], media: dict[str, tuple[str, bytes]]):
        self.next_id, self.rels, self.charts, self.media = 2, [], charts, media

    def rel(self, kind: str, target: str) -> str:
        self.rels.append((f"rId{len(self.rels) + 2}", kind, target))
        return self.rels[-1][0]

    def nv(self, e: dict, holder: str, inner: str, default: str) -> str:
        own = self.next_id
        self.next_id += 1
        hidden = "1" if (e.get("authored") or {}).get("hidden") or e.get("hidden") else None
        return tag(f"p:nv{holder}Pr", None, tag("p:cNvPr", {"id": own, "name": e.get("name") or f"{default} {own - 1}", "descr": e.get("description"), "title": e.get("title"), "hidden": hidden}), inner, "<p:nvPr/>")

    def element(self, e: dict) -> str:
        return getattr(self, e["type"])(e)

    def _sp(self, e: dict, box: bool) -> str:
        look = e.get("authored") or e
        line = tag("a:ln", {"w": emu(look["lineWidth"]) if look.get("lineWidth") else None}, solid(look["lineColor"])) if look.get("lineColor") else ""
        props = tag("p:spPr", None, xfrm(e["transform"]), tag("a:prstGeom", {"prst": look.get("geometry") or "rect"}, "<a:avLst/>"), solid(look.get("fillColor")) or ("<a:noFill/>" if box else ""), line)
        text = body("p:txBody", e.get("body"), e.get("paragraphs") or []) if box or e.get("paragraphs") else ""
        return tag("p:sp", None, self.nv(e, "Sp", tag("p:cNvSpPr", {"txBox": "1"} if box else {}), "TextBox" if box else "Shape"), props, text)

    def text(self, e: dict) -> str:
        return self._sp(e, True)

    def shape(self, e: dict) -> str:
        return self._sp(e, False)

    def image(self, e: dict) -> str:
        name, _ = self.media[e["mediaKey"]]
        crop = e.get("crop") or {}
        src = tag("a:srcRect", {k[0]: units(v, 1000) for k, v in crop.items()}) if crop else ""
        blip = tag("p:blipFill", None, tag("a:blip", {"r:embed": self.rel("image", f"../media/{name}")}), src, "<a:stretch><a:fillRect/></a:stretch>")
        return tag("p:pic", None, self.nv(e, "Pic", "<p:cNvPicPr/>", "Picture"), blip, tag("p:spPr", None, xfrm(e["transform"]), '<a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'))

    def _frame(self, e: dict, default: str, uri: str, data: str) -> str:
        return tag("p:graphicFrame", None, self.nv(e, "GraphicFrame", "<p:cNvGraphicFramePr/>", default), xfrm(e["transform"], "p:xfrm"), tag("a:graphic", None, tag("a:graphicData", {"uri": f"{_O}drawingml/2006/{uri}"}, data)))

    def table(self, e: dict) -> str:
        rows = []
        for r in e["rows"]:
            cells = []
            for c in r["cells"]:
                if len(c) == 1 and _AS_IS.match(text := c.get("text") or "") and text:
                    cells.append(f"<a:tc>{CELL_BEFORE}<a:t>{text}</a:t>{CELL_BEHIND}")
                    continue
                if c.keys() <= PLAIN_CELL and "\n" not in (text := c.get("text") or ""):
                    head = "<a:tc>" if len(c) == 1 and text else cell_start(c.get("rowSpan"), c.get("colSpan"), bool(c.get("hMerge")), bool(c.get("vMerge")))
                    cells.append(f"{head}{CELL_BEFORE}{text_node(text)}{CELL_BEHIND}" if text else head + CELL_EMPTY)
                    continue
                sides = [tag(f"a:ln{k}", {"w": emu(b.get("width", 1))}, solid(b["color"])) for k, side in (("L", "left"), ("R", "right"), ("T", "top"), ("B", "bottom")) if (b := (c.get("borders") or {}).get(side))]
                a = {"rowSpan": c.get("rowSpan"), "gridSpan": c.get("colSpan"), "hMerge": "1" if c.get("hMerge") else None, "vMerge": "1" if c.get("vMerge") else None}
                lines = c.get("paragraphs") or [{"children": [{"text": t}] if t else []} for t in (c.get("text") or "").split("\n")]
                cells.append(tag("a:tc", a, body("a:txBody", None, lines), tag("a:tcPr", None, *sides, *([solid(c["fillColor"])] if c.get("fillColor") else []))))
            rows.append(f'<a:tr h="{emu(r["height"])}">{"".join(cells)}</a:tr>' if cells else tag("a:tr", {"h": emu(r["height"])}))
        grid = tag("a:tblGrid", None, *(tag("a:gridCol", {"w": emu(w)}) for w in e["columns"]))
        flags = {k: "1" for k in ("firstRow", "firstCol", "lastRow", "lastCol", "bandRow", "bandCol") if e.get(k)}
        return self._frame(e, "Table", "table", tag("a:tbl", None, tag("a:tblPr", flags), grid, *rows))

    def chart(self, e: dict) -> str:
        self.charts.append(chart_xml(e))
        rid = self.rel("chart", f"../charts/chart{len(self.charts)}.xml")
        return self._frame(e, "Chart", "chart", f'<c:chart xmlns:c="{_O}drawingml/2006/chart" r:id="{rid}"/>')

    def group(self, e: dict) -> str:
        nv = self.nv(e, "GrpSp", "<p:cNvGrpSpPr/>", "Group")
        t = e["transform"]
        space = e.get("childSpace") or t.get("childSpace") or {"x": t["x"], "y": t["y"], "width": t["width"], "height": t["height"]}
        return tag("p:grpSp", None, nv, tag("p:grpSpPr", None, xfrm(t, "a:xfrm", space)), *map(self.element, e["elements"]))


def chart_xml(e: dict) -> str:
    kind = e.get("chartType", "bar").removesuffix("Chart")
    series = []
    for i, s in enumerate(e["series"]):
        col = column_name(i + 2)
        n = len(s["values"])
        cats = "".join(f'<c:pt idx="{j}"><c:v>{escape_xml(str(x))}</c:v></c:pt>' for j, x in enumerate(s["categories"]))
        vals = "".join(f'<c:pt idx="{j}"><c:v>{js_number(float(v))}</c:v></c:pt>' for j, v in enumerate(s["values"]))
        paint = tag("c:spPr", None, solid(s["color"])) if s.get("color") else ""
        series.append(
            f'<c:ser><c:idx val="{i}"/><c:order val="{i}"/><c:tx><c:strRef><c:f>Sheet1!${col}$1</c:f><c:strCache><c:ptCount val="1"/><c:pt idx="0"><c:v>{escape_xml(s.get("name") or "")}</c:v></c:pt></c:strCache></c:strRef></c:tx>{paint}'
            f'<c:cat><c:strRef><c:f>Sheet1!$A$2:$A${n + 1}</c:f><c:strCache><c:ptCount val="{n}"/>{cats}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:f>Sheet1!${col}$2:${col}${n + 1}</c:f><c:numCache><c:formatCode>General</c:formatCode><c:ptCount val="{n}"/>{vals}</c:numCache></c:numRef></c:val></c:ser>'
        )
    before = {"bar": f'<c:barDir val="{e.get("barDirection") or "col"}"/><c:grouping val="{e.get("grouping") or "clustered"}"/>', "line": f'<c:grouping val="{e.get("grouping") or "standard"}"/>'}.get(kind, "")
    after = {"bar": '<c:axId val="1"/><c:axId val="2"/>', "line": f'<c:marker val="1"/>{"" }<c:axId val="1"/><c:axId val="2"/>' if e.get("marker") else '<c:axId val="1"/><c:axId val="2"/>', "doughnut": f'<c:holeSize val="{int(e.get("holeSize") or 50)}"/>'}.get(kind, "")
    axes = '<c:catAx><c:axId val="1"/><c:crossAx val="2"/></c:catAx><c:valAx><c:axId val="2"/><c:crossAx val="1"/></c:valAx>' if kind in ("bar", "line") else ""
    return f'{HEAD}<c:chartSpace xmlns:c="{_O}drawingml/2006/chart" xmlns:a="{_O}drawingml/2006/main"><c:chart><c:plotArea><c:layout/><c:{kind}Chart>{before}{"".join(series)}{after}</c:{kind}Chart>{axes}</c:plotArea></c:chart></c:chartSpace>'


def rels_xml(rels: list[tuple[str, str, str]]) -> str:
    return f'{HEAD}<Relationships xmlns="{_O}package/2006/relationships">' + "".join(tag("Relationship", {"Id": i, "Type": REL + k, "Target": t}) for i, k, t in rels) + "</Relationships>"


def package_parts(scene: dict) -> list[tuple[str, str | bytes]]:
    """The parts of a scene's package, in archive order."""
    media = {m["key"]: (f"image{i}.{next((x for x, t in MEDIA_TYPES.items() if t == m['mimeType']), 'bin')}", m["data"]) for i, m in enumerate(scene.get("media") or [], 1)}
    charts: list[str] = []
    slides = []
    for i, s in enumerate(scene["slides"], 1):
        w = SlideParts(charts, media)
        inner = "".join(map(w.element, s.get("elements") or []))
        bg = tag("p:bg", None, tag("p:bgPr", None, solid(s["backgroundColor"]), "<a:effectLst/>")) if s.get("backgroundColor") else ""
        slides.append((f"ppt/slides/slide{i}.xml", f"{HEAD}<p:sld {NS}{' show=' + chr(34) + '0' + chr(34) if s.get('hidden') else ''}><p:cSld>{bg}{EMPTY_TREE}{inner}</p:spTree></p:cSld></p:sld>"))
        slides.append((f"ppt/slides/_rels/slide{i}.xml.rels", rels_xml([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), *w.rels])))
    n = len(scene["slides"])
    size = scene["size"]
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i + 1}"/>' for i in range(1, n + 1))
    presentation = f'{HEAD}<p:presentation {NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{units(size["width"], EMU_PER_POINT, True)}" cy="{units(size["height"], EMU_PER_POINT, True)}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
    kinds = [("ppt/presentation.xml", "presentationml.presentation.main"), *((f"ppt/slides/slide{i}.xml", "presentationml.slide") for i in range(1, n + 1)), ("ppt/slideLayouts/slideLayout1.xml", "presentationml.slideLayout"), ("ppt/slideMasters/slideMaster1.xml", "presentationml.slideMaster"), ("ppt/theme/theme1.xml", "theme"), *((f"ppt/charts/chart{i}.xml", "drawingml.chart") for i in range(1, len(charts) + 1))]
    exts = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"} | {name.rpartition(".")[2]: next(t for x, t in MEDIA_TYPES.items() if x == name.rpartition(".")[2]) for name, _ in media.values()}
    types = f'{HEAD}<Types xmlns="{_O}package/2006/content-types">' + "".join(tag("Default", {"Extension": k, "ContentType": v}) for k, v in exts.items()) + "".join(tag("Override", {"PartName": "/" + p, "ContentType": f"{CT}{k}+xml"}) for p, k in kinds) + "</Types>"
    scheme = "".join(tag(f"a:{k}", None, tag("a:srgbClr", {"val": v})) for k, v in THEME_COLORS)
    look = '<a:fmtScheme name="Office"><a:fillStyleLst><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:fillStyleLst><a:lnStyleLst><a:ln w="6350"/></a:lnStyleLst><a:effectStyleLst/><a:bgFillStyleLst><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:bgFillStyleLst></a:fmtScheme>'
    theme = f'{HEAD}<a:theme xmlns:a="{_O}drawingml/2006/main" name="Office"><a:themeElements><a:clrScheme name="Office">{scheme}</a:clrScheme><a:fontScheme name="Office"><a:majorFont><a:latin typeface="Calibri Light"/></a:majorFont><a:minorFont><a:latin typeface="Calibri"/></a:minorFont></a:fontScheme>{look}</a:themeElements></a:theme>'
    return [
        ("[Content_Types].xml", types),
        ("_rels/.rels", rels_xml([("rId1", "officeDocument", "ppt/presentation.xml")])),
        ("ppt/presentation.xml", presentation),
        ("ppt/_rels/presentation.xml.rels", rels_xml([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"rId{i + 1}", "slide", f"slides/slide{i}.xml") for i in range(1, n + 1))])),
        ("ppt/slideMasters/slideMaster1.xml", f'{HEAD}<p:sldMaster {NS}><p:cSld>{EMPTY_TREE}</p:spTree></p:cSld>{CLR_MAP}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'),
        ("ppt/slideMasters/_rels/slideMaster1.xml.rels", rels_xml([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "theme", "../theme/theme1.xml")])),
        ("ppt/slideLayouts/slideLayout1.xml", f'{HEAD}<p:sldLayout {NS} type="blank"><p:cSld name="Blank">{EMPTY_TREE}</p:spTree></p:cSld></p:sldLayout>'),
        ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", rels_xml([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")])),
        ("ppt/theme/theme1.xml", theme),
        *((f"ppt/charts/chart{i}.xml", c) for i, c in enumerate(charts, 1)),
        *((f"ppt/media/{name}", data) for name, data in media.values()),
        *slides,
    ]


def zip_package(parts: list[tuple[str, str | bytes]], level: int = 9) -> bytes:
    """An archive of the parts in order, equal for equal parts: fixed date, no folders."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, data in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.create_system = zipfile.ZIP_DEFLATED, 0
            z.writestr(info, data.encode("utf-8") if isinstance(data, str) else data)
    return out.getvalue()


def create_deck(scene: dict, level: int = 9) -> bytes:
    """The package of a scene. ValueError: the scene is not valid, or what was written does not read back as the scene: slides, kinds, places, texts, cells, chart points and pictures."""
    from slidelake.operators.validate import validate_scene
    from slidelake.sources.deck import Options, parse_deck

    if issues := validate_scene(scene):
        raise ValueError("; ".join(f"{i['path']}: {i['code']}: {i['message']}" for i in issues[:5]))
    raw = zip_package(package_parts(scene), level)
    back = parse_deck(raw, "", Options(strict=True, media=True, tables=frozenset({"slides", "elements", "table_cells", "chart_points", "parts"})))
    if back["status"] != "ok" or len(back.get("slides", [])) != len(scene["slides"]):
        raise ValueError(f"the written package does not read back: {back['code']} {back['message']}")
    want, got = _said(scene), _read(back)
    if want != got:
        at = next(k for k in sorted({*want, *got}) if want.get(k) != got.get(k))
        raise ValueError(f"{at} reads back as {got.get(at)!r}, not as {want.get(at)!r}")
    return raw


def _plain(paragraphs: list[dict]) -> str:
    return "\n".join("".join("\n" if c.get("type") == "break" else c.get("text", "") for c in p.get("children") or []) for p in paragraphs)


def _said(scene: dict) -> dict[str, tuple]:
    """What a scene says of each element, by the key it has when it is read: kind, place (outside groups, whose space is their own), text, cells, points, picture."""
    out: dict[str, tuple] = {}
    media = {m["key"]: sha256(m["data"]) for m in scene.get("media") or []}

    def walk(elements: list[dict], prefix: str, top: bool) -> None:
        for i, e in enumerate(elements, 1):
            key, t, kind = f"{prefix}-element-{i}", e["transform"], e["type"]
            place = (*(emu_to_points(emu(t[k])) for k in ("x", "y", "width", "height")), float(degrees(units(t.get("rotation") or 0, ANGLE_UNITS))), bool(t.get("flipHorizontal")), bool(t.get("flipVertical"))) if top else None
            cells = [(r, c, _plain(x["paragraphs"]) if x.get("paragraphs") else x.get("text") or "") for r, row in enumerate(e["rows"]) for c, x in enumerate(row["cells"])] if kind == "table" else []
            points = [(n, j, str(c), float(v)) for n, s in enumerate(e["series"]) for j, (c, v) in enumerate(zip(s["categories"], s["values"], strict=True))] if kind == "chart" else []
            out[key] = (kind, place, _plain(e.get("paragraphs") or []) if kind in ("text", "shape") else "", cells, points, media.get(e.get("mediaKey")))
            if kind == "group":
                walk(e["elements"], key, False)

    for n, s in enumerate(scene["slides"], 1):
        walk(s.get("elements") or [], f"slide-{n}", True)
    return out


def _read(row: dict) -> dict[str, tuple]:
    """The same of a parsed deck."""
    digests = {p["part"]: p["sha256"] for p in row.get("parts", [])}
    cells: dict[str, list] = {}
    for c in row.get("table_cells", []):
        cells.setdefault(c["key"], []).append((c["row_no"], c["col_no"], c["text"]))
    points: dict[str, list] = {}
    for c in row.get("chart_points", []):
        points.setdefault(c["key"], []).append((c["series_no"], c["idx"], c["category"], c["y"]))
    place = lambda e: tuple(e[k] for k in ("left", "top", "width", "height", "rotate", "flip_h", "flip_v")) if len(e["tree_path"]) == 1 else None
    return {e["key"]: (e["type"], place(e), e["plain_text"] if e["type"] in ("text", "shape") else "", cells.get(e["key"], []), points.get(e["key"], []), digests.get(e.get("media_part"))) for e in row.get("elements", []) if e["origin"] == "slide"}


#: Packages, and their bytes, that go to the JVM together.
BATCH_DECKS, BATCH_BYTES = 256, 4 << 20


def write_decks(scenes: DataFrame, build, level: int = 6, checked: bool = False, block: int | None = None) -> DataFrame:
    """path and content of packages from rows with a path: `build` (row as dict -> scene, or a package) runs on the executors, a row at a time. checked: each scene is validated and its package read back, as in create_deck.

    block: a package for each run of at most so many rows of a task, in order; `build` gets their columns as lists, and the path is the task's and the run's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, raws = [], []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], ["path", "content"])
            paths.clear()
            raws.clear()
            return out

        def rows() -> Iterator[dict]:
            if block is None:
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield batch.slice(i, 1).to_pylist()[0]
                return
            task, n = TaskContext.get().partitionId(), 0
            for batch in batches:
                for i in range(0, batch.num_rows, block):
                    some = batch.slice(i, block)
                    yield {"path": f"{task}-{n}", **{c: some.column(c).to_pylist() for c in some.schema.names}}
                    n += 1

        for row in rows():
            scene = build(row)
            paths.append(row["path"])
            raws.append(scene if isinstance(scene, bytes) else create_deck(scene, level) if checked else zip_package(package_parts(scene), level))
            if len(raws) >= BATCH_DECKS or sum(map(len, raws)) >= BATCH_BYTES:
                yield sent()
        if raws:
            yield sent()

    return scenes.mapInArrow(run, "path string, content binary")


def save_decks(decks: DataFrame, folder: str) -> DataFrame:
    """Sink: writes path and content into a folder that the executors share; each file appears whole. Returns file, bytes and sha256."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{folder}/{path}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}.tmp", "wb") as f:
                    f.write(raw)
                os.replace(f"{target}.{os.getpid()}.tmp", target)
                yield pa.RecordBatch.from_pydict({"file": [path], "bytes": [len(raw)], "sha256": [sha256(raw)]})

    return decks.select("path", "content").mapInArrow(run, "file string, bytes long, sha256 string")
