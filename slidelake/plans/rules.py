"""Registered queries that state a rule of the format each: packages whose slides follow from the keys of the driver's rows are parsed, and the SQL says what must come out.

A slide holds one shape, named by its key; the key's remainders choose among the rule's cases.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.functions import geometry, ooxml
from slidelake.operators import render, roundtrip, validate
from slidelake.operators.writer import HEAD, NS, REL, package_parts, rels_xml, write_decks, zip_package
from slidelake.plans import builders as B
from slidelake.plans.catalog import Parsed, gathered, key_of, parsed, query, read, table
from slidelake.sources.deck import Options
from slidelake.sources.package import Limits
from slidelake.sources.reader import parse_packages

SLIDE, LAYOUT, MASTER, THEME, MAIN = "ppt/slides/slide{}.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml", "ppt/theme/theme1.xml", "ppt/presentation.xml"
RECT = '<a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'
C = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'


def srgb(value: str) -> str:
    return f'<a:solidFill><a:srgbClr val="{value}"/></a:solidFill>'


def body(paragraphs: str, props: str = "<a:bodyPr/>", styles: str = "<a:lstStyle/>") -> str:
    return f"<p:txBody>{props}{styles}{paragraphs}</p:txBody>"


def run(text: object, props: str = "<a:rPr/>") -> str:
    return f"<a:r>{props}<a:t>{text}</a:t></a:r>"


def shape(name: object, look: str = "", text: str = "", nv: str = "", ph: str = "", box: bool = False, outline: str = RECT, style: str = "", xfrm: str | None = None) -> str:
    """A shape of 100 by 50 points."""
    place = '<a:xfrm><a:off x="0" y="0"/><a:ext cx="1270000" cy="635000"/></a:xfrm>' if xfrm is None else xfrm
    return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{name}">{nv}</p:cNvPr><p:cNvSpPr{" txBox=" + chr(34) + "1" + chr(34) if box else ""}/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{place}{outline}{look}</p:spPr>{style}{text}</p:sp>'


def within(parts: dict, part: str, inner: str, end: str = "</p:spTree>") -> None:
    """Puts XML before an end tag of a part."""
    parts[part] = parts[part].replace(end, inner + end, 1)


def deck_of(row: dict, drawn: Callable[[int], str], change: Callable[[dict], None] | None = None) -> bytes:
    """A slide with a shape for each key, then changes to the parts."""
    parts = dict(package_parts(B.scene([[] for _ in row["keys"]])))
    for i, k in enumerate(row["keys"], 1):
        within(parts, SLIDE.format(i), drawn(k))
    if change:
        change(parts)
    return zip_package(list(parts.items()), 1)


def decks(spark: SparkSession, sf_dir: str, drawn: Callable[[int], str], change: Callable[[dict], None] | None = None, options: Options | None = None) -> Parsed:
    keys = gathered(read(spark, sf_dir, "supplier"), "concat('s-', s_suppkey div 50)", "s_suppkey", keys="s_suppkey")
    return parsed(keys, lambda row: deck_of(row, drawn, change), options)


def one_each(spark: SparkSession, sf_dir: str, build: Callable[[int], bytes], options: Options | None = None, must: bool = True) -> Parsed:
    """A package for each supplier."""
    keys = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), "s_suppkey").alias("path"), F.col("s_suppkey").alias("key"))
    return parsed(keys, lambda row: build(row["key"]), options, must)


def elements(found: Parsed, *columns: str | F.Column) -> DataFrame:
    """Columns of the slides' own elements, with the key as supp."""
    return table(found, "elements").where("origin = 'slide'").select(F.col("name").try_cast("long").alias("supp"), *columns)


def changed(scene: dict, edits: dict[str, str | bytes | Callable[[str], str] | None]) -> bytes:
    """The scene's package with parts replaced, edited or (None) left out."""
    parts = dict(package_parts(scene))
    for part, edit in edits.items():
        parts[part] = edit(parts[part]) if callable(edit) else edit
    return zip_package([(n, p) for n, p in parts.items() if p is not None], 1)


# Text boxes.


@query("SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 40 ELSE 5 END::DOUBLE AS l, 3.6::DOUBLE AS t, 7.2::DOUBLE AS r, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 3.6 END::DOUBLE AS b FROM supplier")
def text_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side by itself: the slide's, the layout's, or the default."""

    def drawn(k: int) -> str:
        own = (f' lIns="{k % 40 * 12700}"' if k % 3 == 0 else "") + (' bIns="0"' if k % 2 == 0 else "")
        return shape(k, text=body(f"<a:p>{run('x')}</a:p>", f"<a:bodyPr{own}/>"), ph='<p:ph type="body"/>')

    found = decks(spark, sf_dir, drawn, lambda parts: within(parts, LAYOUT, shape("ph", text=body("<a:p/>", '<a:bodyPr lIns="63500"/>'), ph='<p:ph type="body"/>')))
    return elements(found, *(F.col(f"inset_{s}").alias(s) for s in "ltrb"))


@query("""SELECT s_suppkey AS supp, ['text', 'shape', NULL, NULL][s_suppkey % 4 + 1] AS fit, CASE WHEN s_suppkey % 4 = 0 THEN 62.5 END::DOUBLE AS scale,
['mid', 'down', 'up'][s_suppkey % 3 + 1] AS v_align, s_suppkey % 5 = 0 AS vertical FROM supplier""")
def text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How text is fitted, anchored and turned."""

    def drawn(k: int) -> str:
        fit = ('<a:normAutofit fontScale="62500"/>', "<a:spAutoFit/>", "<a:noAutofit/>", "")[k % 4]
        anchor, vert = ("ctr", "b", "t")[k % 3], ' vert="vert270"' if k % 5 == 0 else ""
        return shape(k, text=body(f"<a:p>{run('x')}</a:p>", f'<a:bodyPr anchor="{anchor}"{vert}>{fit}</a:bodyPr>'))

    return elements(decks(spark, sf_dir, drawn), F.col("auto_fit").alias("fit"), F.col("font_scale").alias("scale"), "v_align", F.col("is_vertical").alias("vertical"))


_FONT = "font-size: 18pt;font-family: &#039;Calibri&#039;;"


@query(f"""SELECT s_suppkey AS supp, CASE s_suppkey % 6 WHEN 0 THEN '<p style="text-align: center;line-height: 1.2;margin-top: 4pt;margin-bottom: 0.5em;"><span style="{_FONT}">' || s_suppkey || '&nbsp;&lt;</span></p>'
WHEN 1 THEN '<p style="text-align: left;margin-left: 36pt;text-indent: -18pt;"><span style="{_FONT}">' || s_suppkey || '</span><span style="{_FONT}font-weight: bold;text-decoration: underline;text-decoration-line: line-through;letter-spacing: 1.5pt;">b</span></p>'
WHEN 2 THEN '<p style="text-align: left;"><span style="{_FONT}">' || s_suppkey || 'y</span><br><span style="{_FONT}vertical-align: super;">z</span></p>'
WHEN 3 THEN '<p style="text-align: left;"><span style="{_FONT}">&nbsp;</span></p>'
WHEN 4 THEN '<ul><li><p style="text-align: left;"><span style="{_FONT}">' || s_suppkey || '</span></p><ol><li><p style="text-align: left;"><span style="{_FONT}">in</span></p></li></ol></li><li><p style="text-align: left;"><span style="{_FONT}">next</span></p></li></ul><p style="text-align: left;"><span style="{_FONT}">out</span></p>'
ELSE '<p style="text-align: left;"><span style="background: linear-gradient(120deg, #FF0000 0%, #0000FF 100%); background-clip: text; color: transparent;{_FONT}text-shadow: 3pt 0pt #111111;">' || s_suppkey || '</span></p>' END AS html FROM supplier""")
def html_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and spans: alignment, spacing, indents, white space and escapes; runs of one style are one span; an empty paragraph keeps its line; lists nest in the item above them; gradients and shadows of letters."""

    def drawn(k: int) -> str:
        text = lambda t, props="": f"<a:p>{f'<a:pPr {props}</a:pPr>' if props else ''}{t}</a:p>"
        spaced = 'algn="ctr"><a:lnSpc><a:spcPct val="120000"/></a:lnSpc><a:spcBef><a:spcPts val="400"/></a:spcBef><a:spcAft><a:spcPct val="50000"/></a:spcAft>'
        grad = '<a:gradFill><a:gsLst><a:gs pos="100000"><a:srgbClr val="0000FF"/></a:gs><a:gs pos="0"><a:srgbClr val="FF0000"/></a:gs></a:gsLst><a:lin ang="1800000"/></a:gradFill><a:effectLst><a:outerShdw dist="38100"><a:srgbClr val="111111"/></a:outerShdw></a:effectLst>'
        cases = (
            text(run(f"{k} &lt;"), spaced), text(run(k) + run("b", '<a:rPr b="1" u="sng" strike="dblStrike" spc="150"/>'), 'marL="457200" indent="-228600">'), text(run(k) + run("y") + "<a:br/>" + run("z", '<a:rPr baseline="30000"/>')), text(""),
            text(run(k), '><a:buChar char="-"/>') + text(run("in"), 'lvl="3"><a:buAutoNum type="arabicPeriod"/>') + text(run("next"), '><a:buChar char="-"/>') + text(run("out")), text(run(k, f"<a:rPr>{grad}</a:rPr>")),
        )
        return shape(k, text=body(cases[k % 6]))

    return elements(decks(spark, sf_dir, drawn), F.col("content").alias("html"))


@query("""SELECT s_suppkey AS supp, i::INT AS para_no, CASE WHEN i = 0 THEN 'ul' WHEN i = 1 THEN 'ol' END AS list, CASE WHEN i = 1 THEN s_suppkey % 11 * (s_suppkey % 11 <= 8)::INT ELSE 0 END::INT AS level FROM supplier, range(3) r(i)""")
def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets, numbers and plain paragraphs; levels from 1 to 8, anything else is level 0."""

    def drawn(k: int) -> str:
        return shape(k, text=body(f'<a:p><a:pPr><a:buChar char="-"/></a:pPr>{run(k)}</a:p><a:p><a:pPr lvl="{k % 11}"><a:buAutoNum type="arabicPeriod"/></a:pPr>{run(k)}</a:p><a:p>{run(k)}</a:p>'))

    return table(decks(spark, sf_dir, drawn), "runs").select(F.col("text").cast("long").alias("supp"), "para_no", F.col("list_type").alias("list"), F.col("list_level").alias("level"))


@query("""SELECT s_suppkey AS supp, ['Calibri', 'Calibri Light', 'Arial'][s_suppkey % 3 + 1] AS face, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 50 + 10) / 2.0 ELSE 18 END::DOUBLE AS size,
s_suppkey % 2 = 0 AS bold, s_suppkey % 3 = 0 AS italic, s_suppkey % 5 = 0 AS underline, s_suppkey % 7 = 0 AS strike, ['super', 'sub', NULL][s_suppkey % 3 + 1] AS baseline, CASE WHEN s_suppkey % 4 = 0 THEN '#00FF00' END AS color FROM supplier""")
def run_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's face (the theme's by reference), size, weight, slant, lines, baseline and colour."""

    def drawn(k: int) -> str:
        a = {"sz": (k % 50 + 10) * 50 if k % 2 == 0 else None, "b": 1 if k % 2 == 0 else 0, "i": "true" if k % 3 == 0 else None, "u": "sng" if k % 5 == 0 else "none", "strike": "sngStrike" if k % 7 == 0 else None, "baseline": (30000, -25000, 0)[k % 3]}
        attrs = "".join(f' {n}="{v}"' for n, v in a.items() if v is not None)
        face = ("", '<a:latin typeface="+mj-lt"/>', '<a:latin typeface="Arial"/>')[k % 3]
        return shape(k, text=body(f"<a:p>{run(k, f'<a:rPr{attrs}>{srgb("00FF00") if k % 4 == 0 else ""}{face}</a:rPr>')}</a:p>"))

    return table(decks(spark, sf_dir, drawn), "runs").select(F.col("text").cast("long").alias("supp"), "face", "size", "bold", "italic", "underline", "strike", "baseline", "color")


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 20 + 90) / 100.0 END::DOUBLE AS line_height, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 10 ELSE 4 END::DOUBLE AS before, CASE WHEN s_suppkey % 3 = 1 THEN 2.5 END::DOUBLE AS after,
CASE WHEN s_suppkey % 5 = 0 THEN -(s_suppkey % 30) END::DOUBLE AS indent, CASE WHEN s_suppkey % 5 = 0 THEN 36 END::DOUBLE AS margin, ['left', 'right', 'justify'][s_suppkey % 3 + 1] AS align FROM supplier""")
def paragraph_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing in percent and in points, indents and margins; what a paragraph leaves open comes from the layout's level."""

    def drawn(k: int) -> str:
        attrs = (f' marL="457200" indent="{-(k % 30) * 12700}"' if k % 5 == 0 else "") + ('', ' algn="r"', ' algn="dist"')[k % 3]
        inner = (f'<a:lnSpc><a:spcPct val="{(k % 20 + 90) * 1000}"/></a:lnSpc>' if k % 2 == 0 else "") + (f'<a:spcBef><a:spcPts val="{k % 10 * 100}"/></a:spcBef>' if k % 3 == 0 else "") + ('<a:spcAft><a:spcPts val="250"/></a:spcAft>' if k % 3 == 1 else "")
        return shape(k, text=body(f"<a:p><a:pPr{attrs}>{inner}</a:pPr>{run(k)}</a:p>"), ph='<p:ph type="body"/>')

    levels = '<a:lstStyle><a:lvl1pPr><a:spcBef><a:spcPts val="400"/></a:spcBef></a:lvl1pPr></a:lstStyle>'
    found = decks(spark, sf_dir, drawn, lambda parts: within(parts, LAYOUT, shape("ph", text=body("<a:p/>", styles=levels), ph='<p:ph type="body"/>')))
    return table(found, "runs").select(F.col("text").cast("long").alias("supp"), "line_height", F.col("space_before").alias("before"), F.col("space_after").alias("after"), "indent", F.col("margin_left").alias("margin"), "align")


@query("SELECT s_suppkey AS supp, CASE s_suppkey % 3 WHEN 0 THEN 'A' || s_suppkey WHEN 1 THEN '_x00' || s_suppkey ELSE chr(9731) || chr(10) || 'z' END AS text FROM supplier")
def office_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`_xHHHH_` is a character; what only looks like it is text; a break is a line end."""

    def drawn(k: int) -> str:
        return shape(k, text=body(f"<a:p>{(run(f'_x0041_{k}'), run(f'_x00{k}'), run('_x2603_') + '<a:br/>' + run('z'))[k % 3]}</a:p>"))

    return elements(decks(spark, sf_dir, drawn), F.col("plain_text").alias("text"))


@query("""SELECT s_suppkey AS supp, CASE s_suppkey % 3 WHEN 0 THEN 'https://x.org/' || s_suppkey WHEN 1 THEN NULL ELSE 'mailto:a@b.c' END AS link, CASE s_suppkey % 3 WHEN 2 THEN 'mailto:a@b.c' END AS run_link FROM supplier""")
def hyperlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of shapes and runs through the slide's own relationships: external ones as they are, scripts not at all."""

    def build(k: int) -> bytes:
        target = (f" https://x.org/{k} ", "javascript:x()", "mailto:a@b.c")[k % 3]
        click = '<a:hlinkClick r:id="rId9"/>'
        inner = shape(k, text=body(f"<a:p>{run(k, f'<a:rPr>{click}</a:rPr>' if k % 3 == 2 else '<a:rPr/>')}</a:p>"), nv=click)
        rel = f'<Relationship Id="rId9" Type="{REL}image" Target="x.png"/><Relationship Id="rId9" Type="{REL}hyperlink" Target="{target}" TargetMode="exTernal"/>'  # of equal ids the last counts
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: s.replace("</p:spTree>", inner + "</p:spTree>"), "ppt/slides/_rels/slide1.xml.rels": lambda s: s.replace("</Relationships>", rel + "</Relationships>")})

    runs = table(one_each(spark, sf_dir, build), "runs").select(F.col("text").cast("long").alias("supp"), F.col("link").alias("run_link"))
    return elements(one_each(spark, sf_dir, build), "link").join(runs, "supp")


# Fills, lines and effects.


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 7 > 0 THEN '#0000FF' END AS color, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 4 + 1 END::DOUBLE AS width, CASE WHEN s_suppkey % 7 > 0 THEN ['solid', 'dashed', 'dotted'][s_suppkey % 3 + 1] END AS type,
CASE WHEN s_suppkey % 7 > 0 THEN ['0', '5', '2, 5'][s_suppkey % 3 + 1] END AS dash, CASE WHEN s_suppkey % 2 = 0 THEN 'triangle' END AS head FROM supplier""")
def border_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines: colour, width, dashes and line ends; an explicit "no line" is none."""

    def drawn(k: int) -> str:
        paint = "<a:noFill/>" if k % 7 == 0 else srgb("0000FF")
        dash = f'<a:prstDash val="{("solid", "dash", "sysDot")[k % 3]}"/>'
        return shape(k, f'<a:ln w="{(k % 4 + 1) * 12700}">{paint}{dash}<a:headEnd type="{"triangle" if k % 2 == 0 else "none"}"/></a:ln>')

    return elements(decks(spark, sf_dir, drawn), F.col("border_color").alias("color"), F.col("border_width").alias("width"), F.col("border_type").alias("type"), F.col("border_dash").alias("dash"), F.col("head_end").alias("head"))


@query("""SELECT s_suppkey AS supp, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 10 WHEN 2 THEN -(s_suppkey % 10) ELSE 0 END::DOUBLE AS h, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey % 10 WHEN 3 THEN -(s_suppkey % 10) ELSE 0 END::DOUBLE AS v, (s_suppkey % 5)::DOUBLE AS blur, '#112233' AS color FROM supplier""")
def outer_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and direction as offsets, and the blur."""

    def drawn(k: int) -> str:
        return shape(k, f'<a:effectLst><a:outerShdw dist="{k % 10 * 12700}" dir="{k % 4 * 5400000}" blurRad="{k % 5 * 12700}"><a:srgbClr val="112233"/></a:outerShdw></a:effectLst>')

    plus = lambda c: (F.col(c) + F.lit(0.0))  # noqa: E731  # no negative zero
    return elements(decks(spark, sf_dir, drawn), plus("shadow_h").alias("h"), plus("shadow_v").alias("v"), F.col("shadow_blur").alias("blur"), F.col("shadow_color").alias("color"))


@query("SELECT s_suppkey AS supp, i::INT AS stop_no, CASE i WHEN 0 THEN 0 WHEN 1 THEN s_suppkey % 99 + 0.5 ELSE 100 END::DOUBLE AS pos, ['#FF0000', '#00FF00', '#0000FF'][i + 1] AS color, (s_suppkey % 36 * 10)::DOUBLE AS angle, CASE WHEN s_suppkey % 2 = 0 THEN 'circle' ELSE 'line' END AS path FROM supplier, range(3) r(i)")
def gradient_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by their places, whatever their order in the file; places beyond the ends are at the ends."""

    def drawn(k: int) -> str:
        stop = lambda pos, c: f'<a:gs pos="{pos}"><a:srgbClr val="{c}"/></a:gs>'
        return shape(k, f"<a:gradFill><a:gsLst>{stop(150000, '0000FF')}{stop('-5%', 'FF0000')}{stop(k % 99 * 1000 + 500, '00FF00')}</a:gsLst><a:lin ang='{k % 36 * 600000}'/><a:path path='{"circle" if k % 2 == 0 else "spiral"}'/></a:gradFill>")

    found = decks(spark, sf_dir, drawn).only("elements", "gradient_stops")
    rows = found.select("deck_id", F.inline("gradient_stops"))
    names = found.select("deck_id", F.inline("elements")).select("deck_id", "key", F.col("name").cast("long").alias("supp"), F.col("gradient_angle").alias("angle"), F.col("gradient_path").alias("path"))
    return rows.join(names, ["deck_id", "key"]).select("supp", "stop_no", "pos", "color", "angle", "path")


@query("""SELECT s_suppkey AS supp, ['pattern', 'image', 'color', NULL][s_suppkey % 4 + 1] AS type, ['#ABCDEF', NULL, '#808080', NULL][s_suppkey % 4 + 1] AS color, CASE WHEN s_suppkey % 4 = 0 THEN 'pct20' END AS pattern, CASE WHEN s_suppkey % 4 = 0 THEN '#ffffff' END AS back,
CASE WHEN s_suppkey % 4 = 1 THEN 'ppt/media/fill.png' END AS media, CASE WHEN s_suppkey % 4 = 1 THEN 0.25 END::DOUBLE AS opacity FROM supplier""")
def fill_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, pictures, a group's fill, and none."""

    def drawn(k: int) -> str:
        fill = ('<a:pattFill prst="pct20"><a:fgClr><a:srgbClr val="ABCDEF"/></a:fgClr></a:pattFill>', '<a:blipFill><a:blip r:embed="rId5"><a:alphaModFix amt="25000"/></a:blip></a:blipFill>', "<a:grpFill/>", "<a:noFill/>")[k % 4]
        inner = shape(k, fill)
        if k % 4 != 2:
            return inner
        return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="7" name="group"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr>{srgb("808080")}</p:grpSpPr>{inner}</p:grpSp>'

    def rels(parts: dict) -> None:
        for part in [p for p in parts if p.startswith("ppt/slides/_rels/")]:
            within(parts, part, f'<Relationship Id="rId5" Type="{REL}image" Target="../media/fill.png"/>', "</Relationships>")

    found = decks(spark, sf_dir, drawn, rels)
    return elements(found, F.col("fill_type").alias("type"), F.col("fill_color").alias("color"), "pattern", F.col("pattern_back").alias("back"), F.col("fill_media").alias("media"), F.col("fill_opacity").alias("opacity")).where("supp is not null")


@query("""SELECT s_suppkey AS supp, CASE s_suppkey % 8 WHEN 0 THEN '#00FF00' WHEN 1 THEN '#FF00FF' WHEN 2 THEN '#FF0000' WHEN 3 THEN '#123456' WHEN 4 THEN '#800000' WHEN 5 THEN '#FFFFFF' WHEN 6 THEN '#BDB76B' ELSE NULL END AS color FROM supplier""")
def color_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue, shares of light, names (in full or short), system colours, and transforms of lightness; a colour that names nothing is none."""

    def drawn(k: int) -> str:
        c = ('<a:hslClr hue="7200000" sat="100%" lum="50000"/>', '<a:scrgbClr r="100000" g="0" b="100%"/>', '<a:prstClr val="red"/>', '<a:sysClr val="windowText" lastClr="123456"/>', '<a:srgbClr val="FF0000"><a:lumMod val="50000"/></a:srgbClr>',
             '<a:srgbClr val="000000"><a:lumOff val="100000"/></a:srgbClr>', '<a:prstClr val="dkKhaki"/>', '<a:prstClr val="nothing"/>')[k % 8]
        return shape(k, f"<a:solidFill>{c}</a:solidFill>")

    return elements(decks(spark, sf_dir, drawn), F.col("fill_color").alias("color"))


@query("""SELECT s_suppkey AS supp, ['#101010', '#202020', '#4472C4', '#fff'][s_suppkey % 4 + 1] AS color FROM supplier""")
def background_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slide's background, the layout's, a reference into the theme, or white."""

    def build(k: int) -> bytes:
        bg = lambda c: f"<p:bg><p:bgPr>{srgb(c)}</p:bgPr></p:bg>"
        ref = '<p:bg><p:bgRef idx="1001"><a:schemeClr val="accent1"/></p:bgRef></p:bg>'
        put = lambda x: lambda s: re.sub(r"(<p:cSld[^>]*>)", lambda m: m[1] + x, s, count=1)
        edits = ({SLIDE.format(1): put(bg("101010")), LAYOUT: put(bg("202020"))}, {LAYOUT: put(bg("202020"))}, {SLIDE.format(1): put(ref)}, {})[k % 4]
        return changed(B.scene([[]]), edits)

    return table(one_each(spark, sf_dir, build), "slides", "path").select(key_of().alias("supp"), F.col("background").alias("color"))


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 1.5 END::DOUBLE AS saturation, 0.2::DOUBLE AS brightness, -0.4::DOUBLE AS contrast, CASE WHEN s_suppkey % 3 = 0 THEN 0.25 END::DOUBLE AS sharpen, CASE WHEN s_suppkey % 3 > 0 THEN 0.5 END::DOUBLE AS soften,
(s_suppkey % 50 * 100)::DOUBLE AS temperature, 0.75::DOUBLE AS opacity FROM supplier""")
def picture_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of pictures; of two extensions the later one counts, and a negative sharpness softens."""

    def build(k: int) -> bytes:
        x = 'xmlns:a14="http://schemas.microsoft.com/office/drawing/2010/main"'
        first = '<a14:saturation sat="400000"/>'
        second = f'<a14:saturation sat="{40000 if k % 2 == 0 else 150000}"/><a14:brightnessContrast bright="20000" contrast="-40000"/><a14:sharpenSoften amount="{25000 if k % 3 == 0 else -50000}"/><a14:colorTemperature colorTemp="{k % 50 * 100}"/>'
        inner = f'<a:alphaModFix amt="75000"/><a:extLst>{"".join(f"<a:ext uri={chr(34)}{i}{chr(34)}><a14:imgProps {x}><a14:imgLayer><a14:imgEffect>{e}</a14:imgEffect></a14:imgLayer></a14:imgProps></a:ext>" for i, e in enumerate((first, second)))}</a:extLst>'
        return changed(B.picture_deck({"keys": [k]}), {SLIDE.format(1): lambda s: re.sub(r'(<a:blip [^>]*)/>', lambda m: f"{m[1]}>{inner}</a:blip>", s)})

    e = table(one_each(spark, sf_dir, build), "elements", "path")
    return e.select(key_of().alias("supp"), "saturation", "brightness", "contrast", "sharpen", "soften", F.col("color_temperature").alias("temperature"), "opacity")


# Trees.


@query("""SELECT s_suppkey AS supp, ['group', 'math', 'none'][s_suppkey % 3 + 1] AS type, CASE WHEN s_suppkey % 3 = 1 THEN '\\frac{' || s_suppkey || '}{2}' END AS latex FROM supplier WHERE s_suppkey % 3 < 2""")
def alternate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an alternative the fallback's group, a formula as such, or nothing."""

    def drawn(k: int) -> str:
        group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="7" name="{k}"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/></p:grpSp>'
        formula = f'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:f><m:num><m:r><m:t>{k}</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath>'
        choice = ("<p:pic/>", shape("choice", text=body(f"<a:p>{formula}</a:p>")), "")[k % 3]
        return f'<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><mc:Choice Requires="p14">{choice}</mc:Choice><mc:Fallback>{(group, shape(k), "")[k % 3]}</mc:Fallback></mc:AlternateContent>'

    return elements(decks(spark, sf_dir, drawn), "type", "latex")


@query("SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 2 = 0 THEN 'layout,master,slide' ELSE 'layout,slide' END AS origins FROM supplier")
def layout_decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the layout stand on its slides, and those of the master unless the slide says no; placeholders don't."""

    def build(k: int) -> bytes:
        put = lambda x: lambda s: s.replace("</p:spTree>", x + "</p:spTree>")
        hide = (lambda s: s) if k % 2 == 0 else (lambda s: s.replace("<p:sld ", '<p:sld showMasterSp="0" ', 1))
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: hide(put(shape("own"))(s)), LAYOUT: put(shape("l") + shape("ph", ph='<p:ph type="title"/>')), MASTER: put(shape("m"))})

    e = table(one_each(spark, sf_dir, build), "elements", "path")
    return e.groupBy(key_of().alias("supp")).agg(F.array_join(F.array_sort(F.collect_list("origin")), ",").alias("origins"))


@query("SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 100 END::DOUBLE AS width, CASE WHEN s_suppkey % 3 = 0 THEN 'non-finite-number' END AS code FROM supplier")
def nonfinite_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size below 0 can't be a number of points: it becomes 0, and a diagnostic says so."""

    def build(k: int) -> bytes:
        x = f'<a:xfrm><a:off x="0" y="0"/><a:ext cx="{-5 if k % 3 == 0 else 1270000}" cy="635000"/></a:xfrm>'
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: s.replace("</p:spTree>", shape(k, xfrm=x) + "</p:spTree>")})

    found = one_each(spark, sf_dir, build).only("elements", "diagnostics")
    return found.select(key_of().alias("supp"), F.col("elements")[0]["width"].alias("width"), F.get("diagnostics", F.lit(0))["code"].alias("code"))


@query("SELECT s_suppkey AS supp, 'ok' AS status, ['shape', 'chart', 'text', 'table', 'shape'][s_suppkey % 5 + 1] AS type FROM supplier")
def bad_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none, in colours, charts, levels, spans and guides: the deck is read all the same."""
    chart = {"type": "chart", "transform": B.BOX, "chartType": "doughnut", "series": [{"name": "s", "categories": ["a"], "values": [1]}]}

    def build(k: int) -> bytes:
        kind = k % 5
        if kind == 1:
            return changed(B.scene([[chart]]), {"ppt/charts/chart1.xml": lambda s: s.replace('<c:holeSize val="50"/>', '<c:holeSize val="abc"/>')})
        if kind == 3:
            return changed(B.scene([[B.table_of([["x"]])]]), {SLIDE.format(1): lambda s: s.replace("<a:tc>", '<a:tc rowSpan="²" gridSpan="99999999999999999999">')})
        bad = (shape(k, '<a:solidFill><a:hslClr hue="x" sat="1" lum="nan"/></a:solidFill>'), "", shape(k, text=body(f'<a:p><a:pPr lvl="²" marL="1e9" indent="--1"/>{run(k, "<a:rPr sz=" + chr(34) + "huge" + chr(34) + "/>")}</a:p>'), outline="", box=True), "",
               shape(k, outline='<a:custGeom><a:gdLst><a:gd name="g" fmla=""/><a:gd name="t" fmla="tan inf x"/></a:gdLst><a:pathLst><a:path w="x" h="inf"><a:moveTo><a:pt x="g" y="t"/></a:moveTo></a:path></a:pathLst></a:custGeom>'))[kind]
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: s.replace("</p:spTree>", bad + "</p:spTree>")})

    return one_each(spark, sf_dir, build, must=False).only("elements").select(key_of().alias("supp"), "status", F.get("elements", F.lit(0))["type"].alias("type"))


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 2 = 0 THEN 7.5 ELSE 10 END::DOUBLE AS x, CASE WHEN s_suppkey % 2 = 0 THEN 25 ELSE 20 END::DOUBLE AS y, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 20 END::DOUBLE AS w, 10::DOUBLE AS h FROM supplier""")
def turned_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child that stands on its side scales along its own axes about its centre: in a group half as wide as its space, its height is halved, not its width."""

    def drawn(k: int) -> str:
        child = shape(k, xfrm=f'<a:xfrm rot="{5400000 if k % 2 == 0 else 10800000}"><a:off x="254000" y="127000"/><a:ext cx="{254000 if k % 2 == 1 else 127000}" cy="{127000 if k % 2 == 1 else 254000}"/></a:xfrm>')
        space = '<a:xfrm><a:off x="0" y="127000"/><a:ext cx="1270000" cy="1270000"/><a:chOff x="0" y="0"/><a:chExt cx="{}" cy="1270000"/></a:xfrm>'.format(1270000)
        space = space.replace('cx="1270000" cy="1270000"/><a:chOff', 'cx="635000" cy="1270000"/><a:chOff') if k % 2 == 0 else space.replace('x="0" y="127000"', 'x="-127000" y="127000"')
        return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="7" name="group"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr>{space}</p:grpSpPr>{child}</p:grpSp>'

    return elements(decks(spark, sf_dir, drawn), F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h")).where("supp is not null")


@query("""SELECT s_suppkey AS supp, ['image', 'video', 'video', 'audio'][s_suppkey % 4 + 1] AS type, ['data', 'link', 'ref', 'data'][s_suppkey % 4 + 1] AS mode, ['custom:triangle', 'rect', 'rect', 'rect'][s_suppkey % 4 + 1] AS shape FROM supplier""")
def media_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and playable media with their bytes, external films as links, other films by name; outlines of pictures, custom ones by their class."""

    def build(k: int) -> bytes:
        kind = k % 4
        tag = ("", '<a:videoFile r:link="rId8"/>', '<a:videoFile r:link="rId8"/>', '<a:audioFile r:link="rId8"/>')[kind]
        target = ("", "https://x.org/film", "../media/film.avi", "../media/sound.mp3")[kind]
        at = lambda t, x, y: f'<a:{t}><a:pt x="{x}" y="{y}"/></a:{t}>'
        outline = f'<a:custGeom><a:pathLst><a:path w="10" h="10">{at("moveTo", 0, 0)}{at("lnTo", 10, 0)}{at("lnTo", 5, 10)}<a:close/></a:path></a:pathLst></a:custGeom>' if kind == 0 else RECT
        mode = ' TargetMode="External"' if kind == 1 else ""
        rel = f'<Relationship Id="rId8" Type="{REL}video" Target="{target}"{mode}/>' if kind else ""
        return changed(B.picture_deck({"keys": [k]}), {
            SLIDE.format(1): lambda s: s.replace("<p:nvPr/></p:nvPicPr>", f"<p:nvPr>{tag}</p:nvPr></p:nvPicPr>").replace(RECT, outline), "ppt/slides/_rels/slide1.xml.rels": lambda s: s.replace("</Relationships>", rel + "</Relationships>"),
        })

    e = table(one_each(spark, sf_dir, build), "elements", "path")
    return e.select(key_of().alias("supp"), "type", F.col("media_mode").alias("mode"), F.col("shape_type").alias("shape"))


# Outlines.


@query("SELECT s_suppkey AS supp, (s_suppkey % 90 * 1000 / 50000.0)::DOUBLE AS adj FROM supplier")
def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustments are given values only."""

    def drawn(k: int) -> str:
        return shape(k, outline=f'<a:prstGeom prst="roundRect"><a:avLst><a:gd name="adj" fmla="val {k % 90 * 1000}"/><a:gd name="other" fmla="*/ w 1 2"/></a:avLst></a:prstGeom>')

    return elements(decks(spark, sf_dir, drawn), F.col("keypoints")["adj"].alias("adj"))


#: Corners of presets as shares of the box, (x, y) from the start; lines are not closed.
CORNERS = {
    "rect": "0 0 1 0 1 1 0 1", "diamond": "0.5 0 1 0.5 0.5 1 0 0.5", "triangle": "0.5 0 1 1 0 1", "rtTriangle": "0 0 1 1 0 1", "line": "0 0 1 1", "lineInv": "0 1 1 0", "straightConnector1": "0 0 1 1", "bentConnector2": "0 0 1 0 1 1", "bentConnector3": "0 0 0.5 0 0.5 1 1 1",
    "flowChartProcess": "0 0 1 0 1 1 0 1", "flowChartDecision": "0.5 0 1 0.5 0.5 1 0 0.5", "flowChartExtract": "0.5 0 1 1 0 1", "flowChartMerge": "0 0 1 0 0.5 1", "flowChartManualOperation": "0 0 1 0 0.8 1 0.2 1", "flowChartManualInput": "0 0.2 1 0 1 1 0 1", "flowChartInputOutput": "0.2 0 1 0 0.8 1 0 1",
    "flowChartPreparation": "0.2 0 0.8 0 1 0.5 0.8 1 0.2 1 0 0.5", "flowChartPunchedCard": "0.2 0 1 0 1 1 0 1 0 0.2", "flowChartOffpageConnector": "0 0 1 0 1 0.8 0.5 1 0 0.8", "flowChartCollate": "0 0 1 0 0.5 0.5 1 1 0 1 0.5 0.5", "diagStripe": "0 0.5 0.5 0 1 0 0 1",
}
_OPEN = ("line", "lineInv", "straightConnector1", "bentConnector2", "bentConnector3")
_VALUES = ", ".join(f"('{n}', [{', '.join(c.split())}]::DOUBLE[], {n not in _OPEN})" for n, c in CORNERS.items())


@query(f"""SELECT p_size, name, 'M ' || list_aggregate([format('{{:g}}', round(c[2 * i + 1] * p_size * 2, 4)) || ' ' || format('{{:g}}', round(c[2 * i + 2] * p_size, 4)) for i in range(len(c) // 2)], 'string_agg', ' L ') || CASE WHEN closed THEN ' Z' ELSE '' END AS path, true AS exact, NOT closed AS stroke_only
FROM (SELECT DISTINCT p_size FROM part), (VALUES {_VALUES}) v(name, c, closed)""")
def preset_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets with straight sides, in boxes of the parts' sizes."""

    @F.pandas_udf("path string, exact boolean")
    def path(name: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([geometry.preset_path(n, float(s) * 2, float(s)) for n, s in zip(name, size, strict=True)], columns=["path", "exact"])

    sizes = read(spark, sf_dir, "part").select("p_size").distinct()
    rows = sizes.select("p_size", F.explode(F.array(*map(F.lit, CORNERS))).alias("name")).select("p_size", "name", path("name", "p_size").alias("p"))
    return rows.select("p_size", "name", "p.*", F.col("name").isin(*geometry.STROKE_ONLY).alias("stroke_only"))


@query("""SELECT s_suppkey AS supp, CASE s_suppkey % 3 WHEN 0 THEN 'M 0 0 L 100 0 L 100 50 L 0 50 Z' WHEN 1 THEN 'M ' || format('{:g}', (s_suppkey % 50)::DOUBLE) || ' 1 L 100 50 L 0 50 Z' ELSE 'M 0 25 L 100 25' END AS path,
['rect', 'triangle', 'custom'][s_suppkey % 3 + 1] AS type, s_suppkey % 3 = 2 AS stroke_only FROM supplier""")
def custom_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in their own space, corners from guides that name each other, classes of outlines, and outlines without an area."""

    def drawn(k: int) -> str:
        at = lambda tag, x, y: f'<a:{tag}><a:pt x="{x}" y="{y}"/></a:{tag}>'
        guides = f'<a:gdLst><a:gd name="g" fmla="*/ twice 1 2"/><a:gd name="twice" fmla="+- {k % 50} {k % 50} 0"/><a:gd name="loop" fmla="+- loop 1 0"/></a:gdLst>'
        inner = (at("moveTo", "l", "t") + at("lnTo", "r", "t") + at("lnTo", "r", "b") + at("lnTo", "l", "b") + "<a:close/>", at("moveTo", "g", "loop") + at("lnTo", "w", "h") + at("lnTo", 0, "h") + "<a:close/>", at("moveTo", 0, "vc") + at("lnTo", "r", "vc"))[k % 3]
        return shape(k, outline=f'<a:custGeom>{guides}<a:pathLst><a:path w="100" h="50"{" fill=" + chr(34) + "none" + chr(34) if k % 3 == 2 else ""}>{inner}</a:path></a:pathLst></a:custGeom>')

    return elements(decks(spark, sf_dir, drawn), F.col("svg_path").alias("path"), F.col("shape_type").alias("type"), "stroke_only")


#: Outlines in a space of 100 by 100: commands and points.
CLASSES = {
    "rect": "M 0 0 L 100 0 L 100 100 L 0 100 Z", "rhombus": "M 50 0 L 100 50 L 50 100 L 0 50 Z", "parallelogram": "M 20 0 L 100 0 L 80 100 L 0 100 Z", "trapezoid": "M 20 0 L 80 0 L 100 100 L 0 100 Z", "triangle": "M 50 0 L 100 100 L 0 100 L 50 0 Z", "pentagon": "M 50 0 L 100 40 L 80 100 L 20 100 L 0 40 Z",
    "hexagon": "M 25 0 L 75 0 L 100 50 L 75 100 L 25 100 L 0 50 Z", "ellipse": "M 100 50 C 100 78 78 100 50 100 C 22 100 0 78 0 50 C 0 22 22 0 50 0 C 78 0 100 22 100 50 Z", "roundRect": "M 10 0 L 90 0 C 95 0 100 5 100 10 L 100 90 C 100 95 95 100 90 100 L 10 100 C 5 100 0 95 0 90 L 0 10 C 0 5 5 0 10 0 Z", "custom": "M 0 0 L 100 0 L 100 100 L 0 100",
}
_CLASSES = ", ".join(f"'{n}'" for n in CLASSES)


@query(f"SELECT s_suppkey AS supp, [{_CLASSES}][s_suppkey % {len(CLASSES)} + 1] AS type FROM supplier")
def outline_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of custom outlines; one that is open has none."""

    def drawn(k: int) -> str:
        inner = ""
        for m in re.finditer(r"([MLCZ])([^MLCZ]*)", list(CLASSES.values())[k % len(CLASSES)]):
            xy = m[2].split()
            points = "".join(f'<a:pt x="{x}" y="{y}"/>' for x, y in zip(xy[::2], xy[1::2], strict=True))
            tag = {"M": "moveTo", "L": "lnTo", "C": "cubicBezTo", "Z": "close"}[m[1]]
            inner += f"<a:{tag}>{points}</a:{tag}>"
        return shape(k, outline=f'<a:custGeom><a:pathLst><a:path w="100" h="100">{inner}</a:path></a:pathLst></a:custGeom>')

    return elements(decks(spark, sf_dir, drawn), F.col("shape_type").alias("type"))


# Charts, diagrams, formulas.


def _chart(k: int, inner: str) -> bytes:
    scene = B.scene([[{"type": "chart", "transform": B.BOX, "name": str(k), "chartType": "bar", "series": [{"name": "s", "categories": ["a"], "values": [1]}]}]])
    return changed(scene, {"ppt/charts/chart1.xml": f"{HEAD}<c:chartSpace {C}><c:chart><c:plotArea>{inner}</c:plotArea></c:chart></c:chartSpace>"})


def _numbers(tag: str, *values: object) -> str:
    return f"<c:{tag}><c:numLit>{''.join(f'<c:pt idx={chr(34)}{i}{chr(34)}><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values))}</c:numLit></c:{tag}>"


@query("SELECT s_suppkey AS supp, r::INT AS row_no, i::INT AS idx, CASE WHEN r = 0 THEN i * 10 WHEN i = 2 THEN 0 ELSE s_suppkey + r * i END::DOUBLE AS v FROM supplier, range(3) a(r), range(3) b(i)")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first series' x values, then each series' y values; what is no number is 0."""

    def build(k: int) -> bytes:
        series = "".join(f"<c:ser>{_numbers('xVal', 0, 10, 20)}{_numbers('yVal', k, k + r, 'x')}</c:ser>" for r in (1, 2))
        return _chart(k, f"<c:{('scatter', 'bubble')[k % 2]}Chart>{series}</c:{('scatter', 'bubble')[k % 2]}Chart>")

    return table(one_each(spark, sf_dir, build), "chart_xy", "path").select(key_of().alias("supp"), "row_no", "idx", "v")


@query("""SELECT s_suppkey AS supp, ['barChart', 'lineChart', 'doughnutChart', 'areaChart'][s_suppkey % 4 + 1] AS type, CASE WHEN s_suppkey % 4 = 0 THEN 'bar' END AS direction, CASE s_suppkey % 4 WHEN 0 THEN 'stacked' WHEN 1 THEN 'standard' END AS grouping,
CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey % 80 + 10 END::DOUBLE AS hole, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 8 = 1 END AS marker, s_suppkey::DOUBLE AS y FROM supplier""")
def chart_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind of chart that has series, and its options."""

    def build(k: int) -> bytes:
        series = f"<c:ser>{_numbers('val', k)}</c:ser>"
        kind = ("bar", "line", "doughnut", "area")[k % 4]
        options = ('<c:barDir val="bar"/><c:grouping val="stacked"/>', '<c:grouping val="standard"/>' + ('<c:marker val="1"/>' if k % 8 == 1 else ""), f'<c:holeSize val="{k % 80 + 10}"/>', "")[k % 4]
        return _chart(k, f"<c:pieChart/><c:{kind}Chart>{options}{series}</c:{kind}Chart>")

    found = one_each(spark, sf_dir, build).only("elements", "chart_points")
    e = F.col("elements")[0]
    return found.select(key_of().alias("supp"), e["chart_type"].alias("type"), e["bar_dir"].alias("direction"), e["grouping"].alias("grouping"), e["hole_size"].alias("hole"), e["marker"].alias("marker"), F.col("chart_points")[0]["y"].alias("y"))


@query("SELECT s_suppkey AS supp, i::INT AS idx, ['#AA0000', NULL, '#00BB00'][i + 1] AS color FROM supplier, range(3) r(i)")
def slice_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pies and doughnuts are coloured by their points."""

    def build(k: int) -> bytes:
        kind = ("pie", "doughnut")[k % 2]
        point = lambda i, c: f'<c:dPt><c:idx val="{i}"/><c:spPr>{srgb(c).replace("<a:solidFill>", "<a:solidFill xmlns:a=" + chr(34) + "http://schemas.openxmlformats.org/drawingml/2006/main" + chr(34) + ">")}</c:spPr></c:dPt>'
        return _chart(k, f"<c:{kind}Chart><c:ser>{point(0, 'AA0000')}{point(2, '00BB00')}{_numbers('val', 1, 2, 3)}</c:ser></c:{kind}Chart>")

    return table(one_each(spark, sf_dir, build), "chart_points", "path").select(key_of().alias("supp"), "idx", F.col("series_color").alias("color"))


@query("SELECT s_suppkey AS supp, 'item ' || s_suppkey || chr(10) || 'second' AS text, 2 AS items, CASE WHEN s_suppkey % 2 = 0 THEN 'drawn ' || s_suppkey END AS drawn FROM supplier")
def diagram_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a diagram's points, and the shapes of its drawing, which the data part or the slide names."""
    dgm, dsp = "http://schemas.openxmlformats.org/drawingml/2006/diagram", "http://schemas.microsoft.com/office/drawing/2008/diagram"

    def build(k: int) -> bytes:
        point = lambda *texts: f"<dgm:pt><dgm:t>{''.join(f'<a:p>{run(t)}</a:p>' for t in texts)}</dgm:t></dgm:pt>"
        frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="2" name="{k}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="0"/><a:ext cx="1270000" cy="635000"/></p:xfrm><a:graphic><a:graphicData uri="{dgm}"><dgm:relIds xmlns:dgm="{dgm}" r:dm="rId5"/></a:graphicData></a:graphic></p:graphicFrame>'
        data = f'{HEAD}<dgm:dataModel xmlns:dgm="{dgm}" {NS}><dgm:ptLst>{point(f"item {k}")}<dgm:pt/>{point("sec", "ond")}</dgm:ptLst><dgm:extLst><a:ext uri="x"><dsp:dataModelExt xmlns:dsp="{dsp}" relId="rId6"/></a:ext></dgm:extLst></dgm:dataModel>'
        drawing = f'{HEAD}<dsp:drawing xmlns:dsp="{dsp}" {NS}><dsp:spTree>{shape("in", text=body(f"<a:p>{run(f"drawn {k}")}</a:p>")).replace("p:", "dsp:").replace("<asp", "<a:sp")}</dsp:spTree></dsp:drawing>'
        rels = rels_xml([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId5", "diagramData", "../diagrams/data1.xml"), *([("rId6", "diagramDrawing", "../diagrams/drawing1.xml")] if k % 2 == 0 else [])])
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: s.replace("</p:spTree>", frame + "</p:spTree>"), "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/diagrams/data1.xml": data, "ppt/diagrams/drawing1.xml": drawing})

    found = one_each(spark, sf_dir, build).only("elements", "diagram_text")
    text = lambda origin: F.get(F.filter("elements", lambda e: e["origin"] == origin), F.lit(0))["plain_text"]
    return found.select(key_of().alias("supp"), text("slide").alias("text"), F.size("diagram_text").alias("items"), text("diagram").alias("drawn"))


#: Formulas and their LaTeX; braces hold runs, K stands for the key.
FORMULAS = {
    "<m:sSup><m:e>{K}</m:e><m:sup>{2}</m:sup></m:sSup>": "K^{2}", "<m:sSub><m:e>{K}</m:e><m:sub>{i}</m:sub></m:sSub>": "K_{i}", "<m:rad><m:e>{K}</m:e></m:rad>": "\\sqrt{K}", "<m:rad><m:deg>{3}</m:deg><m:e>{K}</m:e></m:rad>": "\\sqrt[3]{K}",
    "<m:m><m:mr><m:e>{K}</m:e><m:e>{b}</m:e></m:mr><m:mr><m:e>{c}</m:e><m:e>{d}</m:e></m:mr></m:m>": "\\begin{matrix} K & b \\\\ c & d \\end{matrix}", "<m:eqArr><m:e>{x=K}</m:e><m:e>{y=2}</m:e></m:eqArr>": "\\begin{cases} x=K \\\\ y=2 \\end{cases}",
    "<m:nary><m:sub>{0}</m:sub><m:sup>{n}</m:sup><m:e>{K}</m:e></m:nary>": "∫_{0}^{n}{K}", '<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{0}</m:sub><m:sup>{n}</m:sup><m:e>{K}</m:e></m:nary>': "∑_{0}^{n}{K}", "<m:limLow><m:e>{lim}</m:e><m:lim>{K}</m:lim></m:limLow>": "lim_{K}",
    "<m:limUpp><m:e>{lim}</m:e><m:lim>{K}</m:lim></m:limUpp>": "lim^{K}", "<m:d><m:e>{K}</m:e></m:d>": "\\left(K\\right)", '<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr><m:e>{K}</m:e></m:d>': "\\left[K\\right]", '<m:d><m:dPr><m:begChr m:val="|"/></m:dPr><m:e>{K}</m:e></m:d>': "|K",
    '<m:d><m:dPr><m:endChr m:val="|"/></m:dPr><m:e>{K}</m:e></m:d>': "K|", "<m:func><m:fName>{sin}</m:fName><m:e>{K}</m:e></m:func>": "\\sin{K}", '<m:groupChr><m:groupChrPr><m:chr m:val="⏞"/></m:groupChrPr><m:e>{K}</m:e></m:groupChr>': "⏞K⏞", "<m:borderBox><m:e>{K}</m:e></m:borderBox>": "\\boxed{K}",
    '<m:bar><m:barPr><m:pos m:val="top"/></m:barPr><m:e>{K}</m:e></m:bar>': "\\overline{K}", "<m:bar><m:e>{K}</m:e></m:bar>": "\\underline{K}", '<m:acc><m:accPr><m:chr m:val="\u0303"/></m:accPr><m:e>{K}</m:e></m:acc>': "\\tilde{K}", "<m:f><m:num>{K}</m:num><m:den>{1}{&lt;}</m:den></m:f>": "\\frac{K}{1<}",
}
_LATEX = ", ".join(f"'{t}'" for t in FORMULAS.values())


@query(f"SELECT s_suppkey AS supp, replace([{_LATEX}][s_suppkey % {len(FORMULAS)} + 1], 'K', s_suppkey::VARCHAR) AS latex FROM supplier")
def math_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of each structure."""

    def drawn(k: int) -> str:
        inner = re.sub(r"\{([^}]*)\}", r"<m:r><m:t>\1</m:t></m:r>", list(FORMULAS)[k % len(FORMULAS)]).replace("K", str(k))
        choice = shape(k, text=body(f'<a:p><m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math">{inner}</m:oMath></a:p>'))
        return f'<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><mc:Choice Requires="a14">{choice}</mc:Choice><mc:Fallback>{shape(k)}</mc:Fallback></mc:AlternateContent>'

    return elements(decks(spark, sf_dir, drawn), "latex")


# Packages.


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 3 = 0 THEN '#111111' ELSE '#111111|#333333' END AS accents, 'A|B' AS fonts, ['transitional', 'strict', 'transitional'][s_suppkey % 3 + 1] AS conformance, (s_suppkey % 500 + 1)::DOUBLE AS width FROM supplier""")
def deck_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents up to the first that is missing, without those that are no plain colour; embedded fonts once each; conformance; size."""

    def build(k: int) -> bytes:
        accents = '<a:accent1><a:srgbClr val="111111"/></a:accent1><a:accent2><a:sysClr val="window"/></a:accent2>' + ("" if k % 3 == 0 else '<a:accent3><a:srgbClr val="333333"/></a:accent3>') + '<a:accent5><a:srgbClr val="555555"/></a:accent5>'
        fonts = "<p:embeddedFontLst>" + "".join(f'<p:embeddedFont><p:font typeface="{f}"/></p:embeddedFont>' for f in "ABA") + "</p:embeddedFontLst>"
        strict = (lambda s: s.replace("http://schemas.openxmlformats.org/presentationml/2006/main", "http://purl.oclc.org/ooxml/presentationml/main")) if k % 3 == 1 else (lambda s: s)
        sized = lambda s: re.sub(r'<p:sldSz cx="\d+"', f'<p:sldSz cx="{(k % 500 + 1) * 12700}"', s)
        return changed(B.scene([[]]), {
            MAIN: lambda s: strict(sized(s.replace("<p:notesSz", fonts + "<p:notesSz"))), THEME: lambda s: re.sub(r"(<a:clrScheme[^>]*>).*(</a:clrScheme>)", lambda m: m[1] + accents + m[2], s),
            "ppt/_rels/presentation.xml.rels": lambda s: s.replace("</Relationships>", f'<Relationship Id="rId99" Type="{REL}theme" Target="theme/theme1.xml"/></Relationships>'),
        })

    info = one_each(spark, sf_dir, build).only()
    return info.select(key_of().alias("supp"), F.array_join("theme_colors", "|").alias("accents"), F.array_join("used_fonts", "|").alias("fonts"), "conformance", "width")


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 10 IN (0, 9) THEN 'ok' ELSE 'failed' END AS status, [NULL, 'invalid-package', 'resource-limit', 'resource-limit', 'resource-limit', 'resource-limit', 'resource-limit', 'resource-limit', 'resource-limit', NULL][s_suppkey % 10 + 1] AS code FROM supplier""")
def package_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No archive; too many bytes, parts, expanded bytes, bytes of a part, elements and levels of XML: each fails its deck and no other. UTF-16 is read."""

    def build(k: int) -> bytes:
        n = k % 10
        deep = "<a:p>" * 60 + "</a:p>" * 60
        edits: tuple = (
            {}, {}, {"ppt/noise.bin": random.Random(1).randbytes(60_000)}, {f"ppt/e{i}.bin": b"" for i in range(40)}, {f"ppt/z{i}.bin": bytes(90_000) for i in range(4)}, {"ppt/large.bin": bytes(150_000)},
            {SLIDE.format(1): lambda s: s.replace("</p:spTree>", "<a:x/>" * 700 + "</p:spTree>")}, {SLIDE.format(1): lambda s: s.replace("</p:spTree>", deep + "</p:spTree>")}, {SLIDE.format(1): lambda s: s.replace("</p:spTree>", "<!--" + "x" * 30_000 + "--></p:spTree>")},
            {MAIN: lambda s: s.replace("UTF-8", "UTF-16").encode("utf-16")},
        )
        raw = changed(B.scene([[]]), edits[n])
        return raw[: len(raw) // 2] if n == 1 else raw

    limits = Limits(input_bytes=50_000, entries=40, expanded_bytes=300_000, part_bytes=100_000, xml_bytes=20_000, xml_depth=50, xml_nodes=600)
    return one_each(spark, sf_dir, build, Options(limits=limits), must=False).only().select(key_of().alias("supp"), "status", "code")


@query("""SELECT s_suppkey AS supp, [NULL, 'invalid-xml', 'invalid-xml', 'missing-part', 'invalid-xml'][s_suppkey % 5 + 1] AS code, ['ok', 'failed', 'failed', 'failed', 'failed'][s_suppkey % 5 + 1] AS strict FROM supplier""")
def part_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types, bytes that are no UTF-8, missing parts and broken XML: a diagnostic, or in strict mode a failure."""

    def build(k: int) -> bytes:
        edits: tuple = ({}, {SLIDE.format(1): lambda s: s.replace(HEAD, HEAD + "<!DOCTYPE x>")}, {SLIDE.format(1): lambda s: s.encode() + b"<!-- \xff -->"}, {SLIDE.format(1): None}, {SLIDE.format(1): lambda s: s[:-3]})
        return changed(B.scene([[B.text_box("x")]]), edits[k % 5])

    lax = one_each(spark, sf_dir, build).only("diagnostics").select(key_of().alias("supp"), F.get("diagnostics", F.lit(0))["code"].alias("code"))
    strict = one_each(spark, sf_dir, build, Options(strict=True), must=False).only().select(key_of().alias("supp"), F.col("status").alias("strict"))
    return lax.join(strict, "supp")


# Plain functions.


def _mapped(df: DataFrame, schema: str, f: Callable[[dict], dict]) -> DataFrame:
    """Rows of a plain function, in Arrow batches."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(r) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run_, schema)


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '_x000D_'), '_x0041_', '_x005F_x0041_')) AS xml, md5(text) AS back, regexp_matches(text, '^\\s|\\s$|  |[\\t\\r\\n]') AS preserve FROM documents WHERE text IS NOT NULL""")
def xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text into XML and back: escapes, entities decoded once, and whether white space must be kept."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")

    def f(r: dict) -> dict:
        xml = ooxml.escape_xml(r["text"])
        return {"doc_id": r["doc_id"], "xml": xml, "back": ooxml.decode_office(ooxml.decode_entities(xml)), "preserve": ooxml.needs_preserve(r["text"])}

    rows = _mapped(docs, "doc_id long, xml string, back string, preserve boolean", f)
    return rows.select("doc_id", F.md5("xml").alias("xml"), F.md5("back").alias("back"), "preserve")


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p><p>')) AS html, md5(text) AS plain, regexp_matches(text, '[^\\s]') AS visible FROM documents WHERE regexp_matches(text, '^[\\x21-\\x7E]([\\n\\x20-\\x7E]*[\\x21-\\x7E])?$')")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of HTML back to lines, entities to characters."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x21-\x7E]([\n\x20-\x7E]*[\x21-\x7E])?\z")).select("doc_id", F.replace(esc(F.col("text")), F.lit("\n"), F.lit("</p><p>")).alias("html"))
    rows = _mapped(docs, "doc_id long, html string, plain string, visible boolean", lambda r: r | {"plain": ooxml.plain_preview(f"<p>{r['html']}</p>"), "visible": ooxml.has_visible_text(r["html"])})
    return rows.select("doc_id", F.md5("html").alias("html"), F.md5("plain").alias("plain"), "visible")


@query("SELECT p_partkey AS part, base64(encode(p_name)) AS encoded, p_name AS decoded, CASE p_partkey % 3 WHEN 0 THEN 'ok' ELSE 'error' END AS strict FROM part")
def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical base64 decodes; line ends and missing padding don't."""
    import base64

    def f(r: dict) -> dict:
        text = base64.b64encode(r["name"].encode()).decode()
        given = (text, text[:2] + "\n" + text[2:], text[:-1] if text.endswith("=") else text + "A")[r["part"] % 3]
        try:
            ooxml.strict_base64(given)
            status = "ok"
        except ValueError:
            status = "error"
        return {"part": r["part"], "encoded": text, "decoded": ooxml.strict_base64(text).decode(), "strict": status}

    return _mapped(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name")), "part long, encoded string, decoded string, strict string", f)


@query("SELECT p_partkey AS part, regexp_replace(p_name, '[aeiou]', chr(65533), 'g') AS text, CASE WHEN p_partkey % 2 = 0 THEN '#' || lpad(lower(to_hex(p_partkey % 65536)), 6, '0') END AS color, 'ppt/' || p_size || '/_rels/' || p_partkey || '.xml.rels' AS rels, '''' || p_brand || '\\''' || '''' AS family FROM part")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that XML can't hold, colours as they are given, relationship parts, families as CSS strings."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.regexp_replace("p_name", "[aeiou]", "\u0001").alias("text"), "p_brand", "p_size")

    def f(r: dict) -> dict:
        c = f"#{r['part'] % 65536:06x}"
        return {"part": r["part"], "text": ooxml.xml_filtered(r["text"]), "color": ooxml.hex_color(c if r["part"] % 2 == 0 else c + "0"), "family": ooxml.css_family(r["p_brand"] + "'"), "rels": ooxml.rels_part(f"ppt/{r['p_size']}/{r['part']}.xml")}

    return _mapped(part, "part long, text string, color string, family string, rels string", f)


@query("SELECT p_partkey AS part, (p_size * 12700)::BIGINT AS emu, (p_size * 100)::BIGINT AS font, (p_size * 60000)::BIGINT AS angle, p_partkey % 2 = 0 AS stored, p_size AS degrees, [10 * p_size, 20 * p_size, 30 * p_size]::BIGINT[] AS grid FROM part")
def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, font sizes and degrees as whole numbers; what is no safe integer is refused; a grid scaled to a total."""

    def f(r: dict) -> dict:
        n = r["p_size"]
        try:
            ooxml.units(n if r["p_partkey"] % 2 == 0 else (float("nan"), 1e300)[n % 2], 12700)
            stored = True
        except (ValueError, OverflowError):
            stored = False
        return {"part": r["p_partkey"], "emu": ooxml.points_to_emu(n), "font": ooxml.units(n, ooxml.FONT_UNITS), "angle": ooxml.units(n, ooxml.ANGLE_UNITS), "stored": stored, "degrees": ooxml.degrees(n * 60000), "grid": ooxml.scaled_grid([1, 2, 3], 60 * n)}

    return _mapped(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "part long, emu long, font long, angle long, stored boolean, degrees int, grid array<long>", f)


# Scenes, snapshots and pictures.


@query("""SELECT s_suppkey AS supp, ['', 'invalid-number', 'invalid-text', 'invalid-color', 'missing-reference', 'invalid-value', 'invalid-number', 'invalid-media', 'invalid-hierarchy,unsupported-feature', 'invalid-merge', 'duplicate-key', 'invalid-key', 'unknown-key', 'unsupported-element', 'invalid-value', 'invalid-value', 'invalid-value', 'invalid-number',
'unknown-key', 'unsupported-feature', 'invalid-number', 'invalid-value', 'invalid-number', 'unsupported-feature', 'missing-reference', 'invalid-value', 'invalid-value', 'unknown-key'][s_suppkey % 28 + 1] AS codes FROM supplier""")
def scene_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each rule that it breaks."""
    series = {"name": "s", "categories": ["a"], "values": [1]}
    chart = {"type": "chart", "transform": B.BOX, "chartType": "bar", "series": [series]}
    box = lambda **more: {"type": "shape", "transform": B.BOX, **more}
    once = box()
    whole = B.scene([[]], themes=[{"key": "t", "name": "t"}], masters=[{"key": "m", "name": "m", "themeKey": "t", "elements": []}], layouts=[{"key": "l", "name": "l", "masterKey": "m", "elements": []}]) | {"slides": [{"layoutKey": "l", "elements": []}]}
    scenes: list[dict] = [
        B.scene([[B.text_box("x")]]), B.scene([[box(transform=B.BOX | {"x": float("nan")})]]), B.scene([[{"type": "text", "transform": B.BOX, "paragraphs": [{"children": [{"text": "\x01"}]}]}]]), B.scene([[box(fillColor="red")]]), B.scene([[{"type": "image", "transform": B.BOX, "mediaKey": "none"}]]),
        B.scene([[chart | {"series": []}]]), B.scene([[chart | {"series": [series | {"values": [float("inf")]}]}]]), B.scene([[]], media=[{"key": "m", "mimeType": "image/jpeg", "data": B.PNG}]), B.scene([[]], themes=[{"key": "t", "name": "t"}]),
        B.scene([[B.table_of([[{"text": "a", "colSpan": 2}, {"text": "b"}]])]]), B.scene([[box(key="k"), box(key="k")]]), B.scene([[box(key="-")]]), B.scene([[]], more=1), B.scene([[{"type": "unsupported"}]]), B.scene([[chart | {"chartType": "radar"}]]),
        B.scene([[B.table_of([["a"]]) | {"rows": [{"height": 20.0, "cells": []}]}]]), B.scene([[chart | {"transform": B.BOX | {"rotation": 5}}]]), B.scene([[{"type": "text", "transform": B.BOX, "paragraphs": [{"children": [{"text": "x", "properties": {"fontSize": 0}}]}]}]]),
        B.scene([[box(colour="#FFFFFF")]]), B.scene([[box(placeholder={"role": "slide-instance", "type": "title"})]]), B.scene([[{"type": "group", "transform": B.BOX, "childSpace": B.BOX | {"width": -1}, "elements": []}]]), B.scene([[B.text_box("x", body={"anchor": "aside"})]]),
        B.scene([[{"type": "text", "transform": B.BOX, "paragraphs": [{"level": 9, "children": []}]}]]), whole, B.scene([[]]) | {"slides": [{"layoutKey": "l", "elements": []}]}, B.scene([[once, once]]), B.scene([[B.table_of([[{"text": "a", "borders": {"left": {"width": 1}}}]])]]),
        B.scene([[{"type": "text", "transform": B.BOX, "paragraphs": [{"children": [{"type": "break", "text": "x"}]}]}]]),
    ]
    keys = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"))
    return _mapped(keys, "supp long, codes string", lambda r: {"supp": r["supp"], "codes": ",".join(sorted({i["code"] for i in validate.validate_scene(scenes[r["supp"] % len(scenes)])}))})


@query("SELECT s_suppkey AS supp, ['ok', 'invalid-json', 'invalid-snapshot', 'digest-mismatch', 'hash-mismatch', 'invalid-source', 'ok', 'invalid-snapshot', 'invalid-snapshot', 'invalid-snapshot', 'document-mismatch', 'target-taken'][s_suppkey % 12 + 1] AS code, CASE WHEN s_suppkey % 12 IN (0, 6) THEN s_name || CASE WHEN s_suppkey % 12 = 6 THEN '!' ELSE '' END END AS text FROM supplier")
def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as JSON and back: whole, edited, and tampered with in each of their parts."""
    import base64
    import json

    def f(r: dict) -> dict:
        n = r["s_suppkey"] % 12
        s = roundtrip.read_snapshot(zip_package(package_parts(B.region_deck({"names": [r["s_name"]]})), 1))
        if n in (6, 8, 11):
            s = roundtrip.replace_text(s, "slide-1-element-1-run-1", r["s_name"] + "!")
        if n == 3:
            s["source"]["packageBase64"] = base64.b64encode(base64.b64decode(s["source"]["packageBase64"]) + b"x").decode()
        if n == 4:
            s["consistency"]["operations"] = "0" * 64
        if n == 5:
            s["source"]["packageBase64"] += "\n"
        if n == 2:
            s["schemaVersion"] = 99
        if n == 7:
            s["source"]["more"] = 1
        if n == 8:
            del s["operations"][0]["expectedText"]
        if n == 9:
            for _ in range(70):
                s["document"] = [s["document"]]
        if n == 10:
            s["document"][0]["transform"]["x"] += 1
            s = roundtrip._sealed(s)
        if n == 11:
            s["operations"].append(s["operations"][0] | {"id": "op-2"})
        text = "{" if n == 1 else json.dumps(s)
        try:
            raw = roundtrip.restore(roundtrip.from_json(text))
        except roundtrip.EditError as e:
            return {"supp": r["s_suppkey"], "code": e.code, "text": None}
        return {"supp": r["s_suppkey"], "code": "ok", "text": roundtrip._strictly(raw)["elements"][0]["plain_text"]}

    return _mapped(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "supp long, code string, text string", f)


@query("""SELECT s_suppkey AS supp, [NULL, 'missing-target', 'invalid-value', 'invalid-json', 'invalid-text', 'no-change', 'invalid-operation', 'invalid-value', 'unsupported-package'][s_suppkey % 9 + 1] AS code, CASE WHEN s_suppkey % 9 = 0 THEN 'R2' END AS level FROM supplier""")
def edit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation that can't be done fails its package and no other."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), "s_suppkey").alias("path"), F.array("s_name").alias("names"), F.col("s_suppkey").alias("k"))

    def build(row: dict) -> bytes:
        """Where the key says so, a slide that the content types don't declare."""
        hide = (lambda x: re.sub(r'<Override PartName="/ppt/slides/slide2[.]xml"[^>]*/>', "", x)) if row["k"] % 9 == 8 else (lambda x: x)
        return changed(B.scene([[B.text_box(row["names"][0])], []]), {"[Content_Types].xml": hide})

    packages = write_decks(s, build, 1)
    n = F.col("k") % 9
    pick = lambda *xs: F.get(F.array(*(x if isinstance(x, F.Column) else F.lit(x) for x in xs)), n.cast("int"))
    run_key, key = "slide-1-element-1-run-1", "slide-1-element-1"
    ops = s.select("path", F.lit(1).alias("seq"), pick("replace-text", "set-transform", "set-transform", "set-transform", "replace-text", "replace-text", "colour", "set-transform", "replace-text").alias("kind"), pick(run_key, "slide-9-element-1", key, key, run_key, run_key, key, key, run_key).alias("target_key"),
                   pick("new", "{}", '{"x": NaN}', "{", "\u0001", F.col("names")[0], "{}", '{"width": "wide"}', "new").alias("value"))
    return roundtrip.edit_packages(packages, ops).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("supp"), "code", "level")


@query("""SELECT s_suppkey AS supp, ['center', 'left', 'right'][s_suppkey % 3 + 1] AS alignment, s_name AS text, s_suppkey % 2 = 0 AS bold, CASE WHEN s_suppkey % 4 = 0 THEN '#AABBCC' END AS color, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 5 + 0.5 END::DOUBLE AS size, CASE WHEN s_suppkey % 7 > 0 THEN 'Arial' END AS family, 2 AS paragraphs FROM supplier""")
def html_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML to paragraphs and runs; declarations that say nothing known are left out, and so are paragraphs without text."""

    def f(r: dict) -> dict:
        k = r["s_suppkey"]
        css = f"font-weight: {700 if k % 2 == 0 else 'normal'};color: {'#AABBCC' if k % 4 == 0 else 'rgb(1,2,3)'};font-size: {f'{k % 5}.5pt' if k % 5 else '0pt'};font-family: {'&quot;Arial&quot;' if k % 7 else 'url(x)'}"
        out = ooxml.html_paragraphs(f'<p style="text-align: {("center", "justify", "right")[k % 3]}"><span style="{css}">{r["s_name"]}</span></p><p><span></span></p><li>bare<br/>text</li>')
        first = out[0]["runs"][0]
        return {"supp": k, "alignment": out[0]["alignment"], "text": first["text"], "bold": first["bold"], "color": first.get("color"), "size": first.get("fontSize"), "family": first.get("fontFamily"), "paragraphs": len(out)}

    return _mapped(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "supp long, alignment string, text string, bold boolean, color string, size double, family string, paragraphs int", f)


@query("""SELECT s_suppkey AS supp, ['unsupported', 'chart', 'table', 'text'][s_suppkey % 4 + 1] AS type, CASE WHEN s_suppkey % 4 = 0 THEN 'areaChart' END AS feature, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey END::DOUBLE AS value, CASE WHEN s_suppkey % 4 >= 2 THEN s_name END AS text FROM supplier""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit sees of a slide: texts, cells, series, and by name what it can't change."""

    def f(r: dict) -> dict:
        k = r["s_suppkey"]
        chart = {"type": "chart", "transform": B.BOX, "chartType": "bar", "series": [{"name": "s", "categories": ["a"], "values": [k]}]}
        scene = B.scene([[(chart, chart, B.table_of([[r["s_name"]]]), B.text_box(r["s_name"]))[k % 4]]])
        raw = changed(scene, {"ppt/charts/chart1.xml": lambda s: s.replace("barChart", "areaChart")} if k % 4 == 0 else {})
        e = roundtrip.read_snapshot(raw)["document"][0]
        return {"supp": k, "type": e["type"], "feature": e.get("feature"), "value": e["series"][0]["values"][0] if "series" in e else None, "text": e["runs"][0]["text"] if "runs" in e else None}

    return _mapped(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "supp long, type string, feature string, value double, text string", f)


@query("SELECT n_regionkey::BIGINT AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS slide_no, 'image/svg+xml' AS mime, 720::DOUBLE AS width, 405::DOUBLE AS height, true AS names_text, 1::BIGINT AS texts, 0::BIGINT AS scripts FROM nation")
def svg_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each slide, of the slide's size, with its text and nothing that runs."""
    names = gathered(read(spark, sf_dir, "nation"), "concat('nation-', n_regionkey)", "n_nationkey", names="n_name")
    pictures = render.render_packages(write_decks(names, B.region_deck, 1)).select("path", "slide_no", "mime", "width", "height", F.col("data").cast("string").alias("svg"))
    rows = pictures.join(names, "path")
    text = F.regexp_replace(F.regexp_replace("svg", "(?s)<text[^>]*>", "\u0001"), "<[^>]*>", "")
    count = lambda p: F.regexp_count("svg", F.lit(p)).cast("long")
    return rows.select(key_of().alias("region"), "slide_no", "mime", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.contains(text, F.get("names", F.col("slide_no") - 1)).alias("names_text"), count(r"<text\b").alias("texts"), count(r"(?i)<script|javascript:|\son\w+=").alias("scripts"))


@query("""SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 36 > 0 THEN (s_suppkey % 36 * 10)::VARCHAR END AS turn, CASE WHEN s_suppkey % 4 = 1 THEN '#0000FF/' || (s_suppkey % 3 + 1) || '/5' END AS stroke, CASE WHEN s_suppkey % 4 = 2 THEN 'translate(100 0) scale(-1 1)' END AS flip,
CASE WHEN s_suppkey % 4 = 3 THEN (s_suppkey % 360)::VARCHAR END AS rotation, CASE s_suppkey % 4 WHEN 0 THEN 'url(#g0)' WHEN 1 THEN 'none' ELSE '#102030' END AS fill FROM supplier WHERE s_suppkey % 36 <> 0 AND s_suppkey % 360 <> 0""")
def svg_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients with their direction, outlines with width and dashes, flips and turns, as the picture has them."""

    def build(k: int) -> bytes:
        look = (
            f"<a:gradFill><a:gsLst><a:gs pos='0'><a:srgbClr val='FF0000'/></a:gs><a:gs pos='100000'><a:srgbClr val='00FF00'/></a:gs></a:gsLst><a:lin ang='{k % 36 * 600000}'/></a:gradFill>", f'<a:noFill/><a:ln w="{(k % 3 + 1) * 12700}">{srgb("0000FF")}<a:prstDash val="dash"/></a:ln>', srgb("102030"), srgb("102030"),
        )[k % 4]
        turn = ("", "", ' flipH="1"', f' rot="{k % 360 * 60000}"')[k % 4]
        inner = shape(k, look, xfrm=f'<a:xfrm{turn}><a:off x="0" y="0"/><a:ext cx="1270000" cy="635000"/></a:xfrm>')
        return changed(B.scene([[]]), {SLIDE.format(1): lambda s: s.replace("</p:spTree>", inner + "</p:spTree>")})

    keys = read(spark, sf_dir, "supplier").where("s_suppkey % 36 <> 0 and s_suppkey % 360 <> 0").select(F.concat(F.lit("s-"), "s_suppkey").alias("path"), F.col("s_suppkey").alias("key"))
    svg = F.col("data").cast("string")
    got = lambda pattern, i=1: F.nullif(F.regexp_extract(svg, pattern, i), F.lit(""))
    stroke = r'stroke="(#[0-9A-F]{6})" stroke-width="([0-9.]+)" stroke-dasharray="([^"]+)"'
    pictures = render.render_packages(write_decks(keys, lambda row: build(row["key"]), 1))
    return pictures.select(key_of().alias("supp"), got(r'gradientTransform="rotate\(([0-9.]+) ').alias("turn"), F.when(got(stroke).isNotNull(), F.concat_ws("/", *(got(stroke, i) for i in (1, 2, 3)))).alias("stroke"), got(r"(translate\(100 0\) scale\(-1 1\))").alias("flip"), got(r" rotate\(([0-9.]+) 50 25\)").alias("rotation"), got(r'<path d="[^"]*" fill="([^"]+)"').alias("fill"))
