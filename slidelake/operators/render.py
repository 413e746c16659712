"""Slides as self-contained SVG previews, with a warning for whatever is only approximated. There is no rasteriser: PNG is not offered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from slidelake.functions.geometry import preset_path
from slidelake.functions.ooxml import escape_html, hex_color, js_number, to_fixed, xml_filtered
from slidelake.sources.deck import Options, parse_deck
from slidelake.sources.package import PackageError

# The limits of a request.
MAX_ELEMENTS, MAX_SLIDES, MAX_SVG, MAX_SCALE, MAX_PIXELS = 10_000, 1000, 128 << 20, 8, 32 << 20
RASTER = ("image/gif", "image/jpeg", "image/png", "image/webp")
# End of fixed values.


class RenderError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Request:
    """slides: numbers from 1 in the order wanted, None for all; scale from above 0 to 8."""

    slides: tuple[int, ...] | None = None
    scale: float = 1.0

    def resolved(self, row: dict) -> list[int]:
        n = len(row.get("slides", []))
        wanted = list(self.slides) if self.slides is not None else list(range(1, n + 1))
        if len(set(wanted)) != len(wanted) or any(not isinstance(s, int) or not 1 <= s <= n for s in wanted):
            raise RenderError("invalid-slides", "slide numbers must exist and differ")
        if len(wanted) > MAX_SLIDES:
            raise RenderError("resource-limit", "too many slides")
        if not 0 < self.scale <= MAX_SCALE or row["width"] * row["height"] * self.scale**2 > MAX_PIXELS:
            raise RenderError("invalid-scale", "the picture would be too large")
        return wanted


def n(x: float | None) -> str:
    return js_number(to_fixed(x or 0.0))


def text_xml(t: str) -> str:
    return escape_html(xml_filtered(t))


class Slide:
    """Draws one slide from its rows."""

    def __init__(self, row: dict, no: int):
        self.row, self.no, self.warnings = row, no, []
        own = lambda name: [r for r in row.get(name, []) if r["slide_no"] == no]
        self.elements, self.cells, self.points, self.stops = own("elements"), own("table_cells"), own("chart_points"), own("gradient_stops")
        self.sizes = {}
        for r in own("runs"):
            self.sizes.setdefault(r["key"], (r["size"], r["color"]))
        self.media = {m["part"]: m for m in row.get("media", [])}
        self.defs: list[str] = []

    def warn(self, e: dict, code: str, message: str) -> None:
        self.warnings.append({"slide_no": self.no, "element_id": e.get("id"), "code": code, "message": message})

    def paint(self, e: dict) -> str:
        kind, c = e.get("fill_type"), hex_color(e.get("fill_color"))
        if kind == "gradient":
            stops = [s for s in self.stops if s["key"] == e["key"]]
            if len(stops) > 1 and all(hex_color(s["color"]) for s in stops):
                name = f"g{len(self.defs)}"
                kind = "radialGradient" if e.get("gradient_path") in ("circle", "shape") else "linearGradient"
                turn = f' gradientTransform="rotate({n(e["gradient_angle"])} 0.5 0.5)"' if kind == "linearGradient" and e.get("gradient_angle") else ""
                self.defs.append(f'<{kind} id="{name}"{turn}>' + "".join(f'<stop offset="{n(s["pos"])}%" stop-color="{s["color"]}"/>' for s in stops) + f"</{kind}>")
                return f'fill="url(#{name})"'
        if kind in ("gradient", "pattern", "image", "group") or kind == "color" and not c:
            self.warn(e, "unsupported-fill", f"{kind} fill is drawn plain")
            c = c or "#cccccc"
        return f'fill="{c}"' if kind and c else 'fill="none"'

    def stroke(self, e: dict) -> str:
        c = hex_color(e.get("border_color"))
        if not c:
            return ""
        dash = f' stroke-dasharray="{e["border_dash"]}"' if e.get("border_dash") not in (None, "0") else ""
        return f' stroke="{c}" stroke-width="{n(e.get("border_width") or 1)}"{dash}'

    def text(self, e: dict, plain: str) -> str:
        if not plain.strip():
            return ""
        size, color = self.sizes.get(e["key"], (18.0, None))
        step = max(size, 12) + 4
        self.warn(e, "font-substitution", "text is drawn in a generic font, without wrapping")
        lines = [f'<tspan x="4" y="{n(size + i * step)}">{text_xml(t)}</tspan>' for i, t in enumerate(plain.split("\n"))]
        return f'<text font-family="sans-serif" font-size="{n(size)}" fill="{hex_color(color) or "#000000"}">{"".join(lines)}</text>'

    def element(self, e: dict) -> str:
        w, h = e["width"], e["height"]
        place = [f"translate({n(e['left'])} {n(e['top'])})"]
        if e.get("rotate"):
            place.append(f"rotate({n(e['rotate'])} {n(w / 2)} {n(h / 2)})")
        if e.get("flip_h") or e.get("flip_v"):
            place.append(f"translate({n(w if e['flip_h'] else 0)} {n(h if e['flip_v'] else 0)}) scale({-1 if e['flip_h'] else 1} {-1 if e['flip_v'] else 1})")
        inner = getattr(self, f"_{e['type']}", self._other)(e, w, h)
        return f'<g transform="{" ".join(place)}">{inner}</g>' if inner else ""

    def _shape(self, e: dict, w: float, h: float) -> str:
        if e.get("shape_type") not in (None, "custom") and not preset_path(e["shape_type"], w, h)[1]:
            self.warn(e, "approximate-shape", f"{e['shape_type']} is drawn as its box")
        fill = 'fill="none"' if e.get("stroke_only") else self.paint(e)
        return f'<path d="{e.get("svg_path") or ""}" {fill}{self.stroke(e)}/>' + self.text(e, e.get("plain_text") or "")

    def _text(self, e: dict, w: float, h: float) -> str:
        return f'<rect width="{n(w)}" height="{n(h)}" {self.paint(e)}{self.stroke(e)}/>' + self.text(e, e.get("plain_text") or "")

    def _group(self, e: dict, w: float, h: float) -> str:
        return ""  # its elements stand in the slide's own space

    def _image(self, e: dict, w: float, h: float) -> str:
        import base64

        m = self.media.get(e.get("media_part") or "")
        if not m or m["mime"] not in RASTER:
            self.warn(e, "missing-image", "the picture can't be embedded")
            return f'<rect width="{n(w)}" height="{n(h)}" fill="#eeeeee"/>'
        t, b, lft, r = (max(-100.0, min(100.0, e.get(f"crop_{k}") or 0.0)) / 100 for k in "tblr")
        iw, ih = w / max(1e-6, 1 - lft - r), h / max(1e-6, 1 - t - b)
        clip = f"c{len(self.defs)}"
        self.defs.append(f'<clipPath id="{clip}"><rect width="{n(w)}" height="{n(h)}"/></clipPath>')
        return f'<image clip-path="url(#{clip})" x="{n(-lft * iw)}" y="{n(-t * ih)}" width="{n(iw)}" height="{n(ih)}" preserveAspectRatio="none" href="data:{m["mime"]};base64,{base64.b64encode(m["bytes"]).decode()}"/>'

    def _table(self, e: dict, w: float, h: float) -> str:
        cells = [c for c in self.cells if c["key"] == e["key"]]
        cols: dict[int, float] = {}
        rows: dict[int, float] = {}
        for c in cells:
            cols.setdefault(c["col_no"], c["width"] or 0)
            rows.setdefault(c["row_no"], c["height"] or 0)

        def edges(sizes: dict[int, float], total: float) -> list[float]:
            whole, out = sum(sizes.values()), [0.0]
            for k in sorted(sizes):
                out.append(out[-1] + (sizes[k] * total / whole if whole else total / len(sizes)))
            return out

        xs, ys = edges(cols, w), edges(rows, h)
        out = []
        for c in cells:
            if c["h_merge"] or c["v_merge"]:
                continue
            x, y = xs[c["col_no"]], ys[c["row_no"]]
            x1, y1 = xs[min(len(xs) - 1, c["col_no"] + (c["col_span"] or 1))], ys[min(len(ys) - 1, c["row_no"] + (c["row_span"] or 1))]
            out.append(f'<rect x="{n(x)}" y="{n(y)}" width="{n(x1 - x)}" height="{n(y1 - y)}" fill="{hex_color(c["fill_color"]) or "none"}"/>')
            for side, ends in (("top", (x, y, x1, y)), ("bottom", (x, y1, x1, y1)), ("left", (x, y, x, y1)), ("right", (x1, y, x1, y1))):
                a, b, c1, d = map(n, ends)
                out.append(f'<line x1="{a}" y1="{b}" x2="{c1}" y2="{d}" stroke="{hex_color(c[f"border_{side}"]) or "#bfbfbf"}"/>')
            if c["text"]:
                out.append(f'<text x="{n(x + 4)}" y="{n(y + 16)}" font-family="sans-serif" font-size="12">{text_xml(c["text"])}</text>')
        self.warn(e, "approximate-table", "cell typography is simplified")
        return "".join(out)

    def _chart(self, e: dict, w: float, h: float) -> str:
        points = [p for p in self.points if p["key"] == e["key"]]
        self.warn(e, "approximate-chart", f"{e['chart_type']} is drawn as bars")
        top = max([1.0, *(abs(p["y"]) for p in points)])
        step = w / max(1, len(points))
        accents = self.row.get("theme_colors") or ["#4472C4", "#ED7D31", "#A5A5A5", "#FFC000", "#5B9BD5", "#70AD47"]
        return "".join(f'<rect x="{n(i * step)}" y="{n(h - h * abs(p["y"]) / top)}" width="{n(step * 0.8)}" height="{n(h * abs(p["y"]) / top)}" fill="{hex_color(p["series_color"]) or accents[i % len(accents)]}"/>' for i, p in enumerate(points))

    def _video(self, e: dict, w: float, h: float) -> str:
        self.warn(e, "approximate-video", "the film is drawn as a screen")
        r = min(w, h) / 6
        return f'<rect width="{n(w)}" height="{n(h)}" fill="#111111"/><path d="M {n(w / 2 - r)} {n(h / 2 - r)} L {n(w / 2 + r)} {n(h / 2)} L {n(w / 2 - r)} {n(h / 2 + r)} Z" fill="#ffffff"/>'

    def _audio(self, e: dict, w: float, h: float) -> str:
        self.warn(e, "approximate-audio", "the sound is drawn as a sign")
        r = min(w, h) / 6
        return f'<rect width="{n(w)}" height="{n(h)}" fill="#f5f5f5"/><circle cx="{n(w / 2)}" cy="{n(h / 2)}" r="{n(r)}" fill="#777777"/>'

    def _math(self, e: dict, w: float, h: float) -> str:
        self.warn(e, "approximate-math", "the formula is drawn as its source")
        return f'<text x="4" y="{n(h / 2)}" font-family="serif" font-style="italic" font-size="14">{text_xml(e.get("latex") or "")}</text>'

    def _diagram(self, e: dict, w: float, h: float) -> str:
        self.warn(e, "approximate-diagram", "the drawing's shapes, or a list of its texts")
        lines = [t for t in (e.get("plain_text") or "").split("\n") if t]
        if any(x["origin"] == "diagram" and x["key"].startswith(e["key"] + "-") for x in self.elements):
            return f'<rect width="{n(w)}" height="{n(h)}" fill="none"/>'
        step = h / max(1, len(lines))
        return "".join(f'<rect y="{n(i * step)}" width="{n(w)}" height="{n(step * 0.8)}" fill="#f5f5f5" stroke="#bfbfbf"/><text x="4" y="{n(i * step + 14)}" font-family="sans-serif" font-size="12">{text_xml(t)}</text>' for i, t in enumerate(lines)) or f'<rect width="{n(w)}" height="{n(h)}" fill="none" stroke="#bfbfbf"/>'

    def _other(self, e: dict, w: float, h: float) -> str:
        label = e.get("latex") or e.get("plain_text") or e["type"]
        self.warn(e, f"approximate-{e['type']}", f"{e['type']} is drawn as a labelled box")
        return f'<rect width="{n(w)}" height="{n(h)}" fill="#f5f5f5" stroke="#bfbfbf"/><text x="4" y="16" font-family="sans-serif" font-size="12">{text_xml(label)}</text>'

    def svg(self, scale: float) -> str:
        if len(self.elements) > MAX_ELEMENTS:
            raise RenderError("resource-limit", "too many elements")
        back = next((s["background"] for s in self.row["slides"] if s["slide_no"] == self.no), None)
        order = {"master": 0, "layout": 1, "slide": 2, "diagram": 3}
        inner = "".join(map(self.element, sorted(self.elements, key=lambda e: order[e["origin"]])))
        w, h = self.row["width"], self.row["height"]
        defs = f"<defs>{''.join(self.defs)}</defs>" if self.defs else ""
        out = f'<svg xmlns="http://www.w3.org/2000/svg" width="{n(w * scale)}" height="{n(h * scale)}" viewBox="0 0 {n(w)} {n(h)}">{defs}<rect width="{n(w)}" height="{n(h)}" fill="{hex_color(back) or "#ffffff"}"/>{inner}</svg>'
        if len(out.encode("utf-8")) > MAX_SVG:
            raise RenderError("resource-limit", "the picture is too large")
        return out


def render_deck(raw: bytes, request: Request = Request()) -> list[dict]:
    """slide_no, format, mime, width, height, data, warnings of the wanted slides. PackageError or RenderError."""
    row = parse_deck(raw, "", Options(strict=True, media=True))
    if row["status"] != "ok":
        raise PackageError(row["code"], row["message"])
    out = []
    for no in request.resolved(row):
        s = Slide(row, no)
        data = s.svg(request.scale)
        out.append({"slide_no": no, "format": "svg", "mime": "image/svg+xml", "width": row["width"] * request.scale, "height": row["height"] * request.scale, "data": data, "warnings": s.warnings})
    return out


def render_packages(packages: DataFrame, request: Request = Request()) -> DataFrame:
    """A row for each wanted slide of each package, its warnings as an array; a package that can't be drawn gives one row with code and message."""
    schema = "path string, slide_no int, format string, mime string, width double, height double, data string, warnings array<struct<slide_no: int, element_id: string, code: string, message: string>>, code string, message string"
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["content"] is None:
                        raise RenderError("resource-limit", "no content, or more than allowed")
                    slides = [{"path": row["path"], **s} for s in render_deck(row["content"], request)]
                except (PackageError, RenderError) as e:
                    slides = [{"path": row["path"], "code": e.code, "message": str(e)}]
                except Exception as e:  # no content of one package may stop the others
                    slides = [{"path": row["path"], "code": "invalid-content", "message": f"{type(e).__name__}: {e}"}]
                if slides:
                    yield pa.RecordBatch.from_pylist([{f.name: s.get(f.name) for f in arrow} for s in slides], schema=arrow)

    return packages.select("path", "content").mapInArrow(run, schema)
