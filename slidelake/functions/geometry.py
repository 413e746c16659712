"""Outlines as SVG paths: preset shapes by family, custom geometry with its guide language, and the classes of custom shapes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from .ooxml import js_number, to_fixed
from .presets import outline

# Presets that have a stroke and no area; sides of regular polygons; points of stars and their inner radius in 100000ths.
STROKE_ONLY = frozenset("line lineInv straightConnector1 bentConnector2 bentConnector3 bentConnector4 bentConnector5 curvedConnector2 curvedConnector3 curvedConnector4 curvedConnector5 arc leftBracket rightBracket leftBrace rightBrace bracketPair bracePair".split())
POLYGONS = {"pentagon": 5, "heptagon": 7, "decagon": 10, "dodecagon": 12}
STARS = {"star4": (4, 12500), "star5": (5, 19098), "star6": (6, 28868), "star7": (7, 34601), "star8": (8, 37500), "star10": (10, 42533), "star12": (12, 37500), "star16": (16, 37500), "star24": (24, 37500), "star32": (32, 37500)}
# End of fixed values.


def num(x: float) -> str:
    return js_number(to_fixed(x))


def polygon(points: list[tuple[float, float]], close: bool = True) -> str:
    return "M " + " L ".join(f"{num(x)} {num(y)}" for x, y in points) + (" Z" if close else "")


def oval(cx: float, cy: float, rx: float, ry: float) -> str:
    return f"M {num(cx - rx)} {num(cy)} A {num(rx)} {num(ry)} 0 1 1 {num(cx + rx)} {num(cy)} A {num(rx)} {num(ry)} 0 1 1 {num(cx - rx)} {num(cy)} Z"


def rounded(w: float, h: float, radii: tuple[float, float, float, float], cut: bool = False) -> str:
    """A rectangle whose corners (from top left, clockwise) are rounded, or cut off."""
    a, b, c, d = radii
    arc = lambda r, x, y: f"L {num(x)} {num(y)}" if cut or not r else f"A {num(r)} {num(r)} 0 0 1 {num(x)} {num(y)}"
    return f"M {num(a)} 0 L {num(w - b)} 0 {arc(b, w, b)} L {num(w)} {num(h - c)} {arc(c, w - c, h)} L {num(d)} {num(h)} {arc(d, 0, h - d)} L 0 {num(a)} {arc(a, a, 0)} Z"


def _inscribed(n: int, w: float, h: float, inner: float | None = None) -> str:
    """n corners on the ellipse from the top; with `inner` (half-widths in 100000ths of the size) a star."""
    out = []
    steps = n if inner is None else 2 * n
    for i in range(steps):
        t = -math.pi / 2 + 2 * math.pi * i / steps
        r = 0.5 if inner is None or i % 2 == 0 else inner / 100000
        out.append((w / 2 + w * r * math.cos(t), h / 2 + h * r * math.sin(t)))
    return polygon(out)


def _arrow(w: float, h: float, shaft: float, head: float, turn: str) -> str:
    """An arrow to the right of length w, its shaft a share of h, its head a share of the smaller side; turned."""
    long, wide = (w, h) if turn in "rl" else (h, w)
    d, s = min(long, min(w, h) * head), wide * shaft / 2
    p = [(0, wide / 2 - s), (long - d, wide / 2 - s), (long - d, 0), (long, wide / 2), (long - d, wide), (long - d, wide / 2 + s), (0, wide / 2 + s)]
    flip = {"r": lambda x, y: (x, y), "l": lambda x, y: (w - x, y), "d": lambda x, y: (y, x), "u": lambda x, y: (y, h - x)}[turn]
    return polygon([flip(x, y) for x, y in p])


def preset_path(name: str, w: float, h: float, adjust: dict[str, float] | None = None) -> tuple[str, bool]:
    """The path of a preset in a box of w by h points, and whether it is exact; presets that aren't built here give the box and False.

    adjust: guides of the shape in 100000ths; those that aren't finite count as absent. A box without area gives a flat rectangle.
    """
    if not (w > 0 and h > 0):
        return polygon([(0, 0), (max(w, 0), 0), (max(w, 0), max(h, 0)), (0, max(h, 0))]), True
    given = {k: v for k, v in (adjust or {}).items() if v is not None and math.isfinite(v)}
    a = lambda k, default: given.get(k, given.get("adj" if k == "adj1" else k, default)) / 100000
    s = min(w, h)
    r = lambda k, default, most=0.5: s * max(0.0, min(a(k, default), most))
    shapes: dict[str, Callable[[], str]] = {
        "ellipse": lambda: oval(w / 2, h / 2, w / 2, h / 2),
        "roundRect": lambda: rounded(w, h, (r("adj", 16667),) * 4),
        "round1Rect": lambda: rounded(w, h, (0, r("adj", 16667), 0, 0)),
        "round2SameRect": lambda: rounded(w, h, (r("adj1", 16667), r("adj1", 16667), r("adj2", 0), r("adj2", 0))),
        "round2DiagRect": lambda: rounded(w, h, (r("adj1", 16667), r("adj2", 0), r("adj1", 16667), r("adj2", 0))),
        "snip1Rect": lambda: rounded(w, h, (0, r("adj", 16667), 0, 0), True),
        "snip2SameRect": lambda: rounded(w, h, (r("adj1", 16667), r("adj1", 16667), r("adj2", 0), r("adj2", 0)), True),
        "snip2DiagRect": lambda: rounded(w, h, (r("adj1", 0), r("adj2", 16667), r("adj1", 0), r("adj2", 16667)), True),
        "triangle": lambda: polygon([(w * max(0, min(1, a("adj", 50000))), 0), (w, h), (0, h)]),
        "rtTriangle": lambda: polygon([(0, 0), (w, h), (0, h)]),
        "diamond": lambda: polygon([(w / 2, 0), (w, h / 2), (w / 2, h), (0, h / 2)]),
        "parallelogram": lambda: polygon([(min(w, s * a("adj", 25000)), 0), (w, 0), (w - min(w, s * a("adj", 25000)), h), (0, h)]),
        "trapezoid": lambda: polygon([(min(w / 2, s * a("adj", 25000)), 0), (w - min(w / 2, s * a("adj", 25000)), 0), (w, h), (0, h)]),
        "hexagon": lambda: polygon([(min(w / 2, s * a("adj", 25000)), 0), (w - min(w / 2, s * a("adj", 25000)), 0), (w, h / 2), (w - min(w / 2, s * a("adj", 25000)), h), (min(w / 2, s * a("adj", 25000)), h), (0, h / 2)]),
        "octagon": lambda: rounded(w, h, (r("adj", 29289),) * 4, True),
        "plus": lambda: polygon([(x, 0), (w - x, 0), (w - x, x), (w, x), (w, h - x), (w - x, h - x), (w - x, h), (x, h), (x, h - x), (0, h - x), (0, x), (x, x)]) if (x := r("adj", 25000)) >= 0 else "",
        "frame": lambda: polygon([(0, 0), (w, 0), (w, h), (0, h)]) + " " + polygon([(x, x), (x, h - x), (w - x, h - x), (w - x, x)]) if (x := r("adj1", 12500)) >= 0 else "",
        "halfFrame": lambda: polygon([(0, 0), (w, 0), (w - w * y / h, y), (x, y), (x, h - h * x / w), (0, h)]) if (y := s * a("adj1", 33333)) is not None and (x := s * a("adj2", 33333)) is not None else "",
        "corner": lambda: polygon([(0, 0), (x, 0), (x, h - y), (w, h - y), (w, h), (0, h)]) if (x := s * a("adj2", 50000)) is not None and (y := s * a("adj1", 50000)) is not None else "",
        "diagStripe": lambda: polygon([(0, h * a("adj", 50000)), (w * a("adj", 50000), 0), (w, 0), (0, h)]),
        "donut": lambda: oval(w / 2, h / 2, w / 2, h / 2) + " " + oval(w / 2, h / 2, w / 2 - r("adj", 25000), h / 2 - r("adj", 25000)),
        "homePlate": lambda: polygon([(0, 0), (w - x, 0), (w, h / 2), (w - x, h), (0, h)]) if (x := min(w, s * a("adj", 50000))) >= 0 else "",
        "chevron": lambda: polygon([(0, 0), (w - x, 0), (w, h / 2), (w - x, h), (0, h), (x, h / 2)]) if (x := min(w, s * a("adj", 50000))) >= 0 else "",
        "rightArrow": lambda: _arrow(w, h, a("adj1", 50000), a("adj2", 50000), "r"),
        "leftArrow": lambda: _arrow(w, h, a("adj1", 50000), a("adj2", 50000), "l"),
        "upArrow": lambda: _arrow(w, h, a("adj1", 50000), a("adj2", 50000), "u"),
        "downArrow": lambda: _arrow(w, h, a("adj1", 50000), a("adj2", 50000), "d"),
        "leftRightArrow": lambda: polygon([(0, h / 2), (d, 0), (d, h / 2 - t), (w - d, h / 2 - t), (w - d, 0), (w, h / 2), (w - d, h), (w - d, h / 2 + t), (d, h / 2 + t), (d, h)]) if (d := min(w / 2, s * a("adj2", 50000))) >= 0 and (t := h * a("adj1", 50000) / 2) is not None else "",
        "upDownArrow": lambda: polygon([(w / 2, 0), (w, d), (w / 2 + t, d), (w / 2 + t, h - d), (w, h - d), (w / 2, h), (0, h - d), (w / 2 - t, h - d), (w / 2 - t, d), (0, d)]) if (d := min(h / 2, s * a("adj2", 50000))) >= 0 and (t := w * a("adj1", 50000) / 2) is not None else "",
        "line": lambda: polygon([(0, 0), (w, h)], False),
        "lineInv": lambda: polygon([(0, h), (w, 0)], False),
        "bentConnector2": lambda: polygon([(0, 0), (w, 0), (w, h)], False),
        "bentConnector3": lambda: polygon([(0, 0), (w * a("adj1", 50000), 0), (w * a("adj1", 50000), h), (w, h)], False),
        "mathPlus": lambda: polygon([(w / 2 - t, y0), (w / 2 + t, y0), (w / 2 + t, h / 2 - t), (w - x0, h / 2 - t), (w - x0, h / 2 + t), (w / 2 + t, h / 2 + t), (w / 2 + t, h - y0), (w / 2 - t, h - y0), (w / 2 - t, h / 2 + t), (x0, h / 2 + t), (x0, h / 2 - t), (w / 2 - t, h / 2 - t)]) if (t := s * a("adj1", 23520) / 2) is not None and (x0 := w * 13245 / 100000) is not None and (y0 := h * 13245 / 100000) is not None else "",
        "mathMinus": lambda: polygon([(w * 13245 / 100000, h / 2 - t), (w * 86755 / 100000, h / 2 - t), (w * 86755 / 100000, h / 2 + t), (w * 13245 / 100000, h / 2 + t)]) if (t := h * a("adj1", 23520) / 2) is not None else "",
        "plaque": lambda: (lambda x: f"M 0 {num(x)} A {num(x)} {num(x)} 0 0 0 {num(x)} 0 L {num(w - x)} 0 A {num(x)} {num(x)} 0 0 0 {num(w)} {num(x)} L {num(w)} {num(h - x)} A {num(x)} {num(x)} 0 0 0 {num(w - x)} {num(h)} L {num(x)} {num(h)} A {num(x)} {num(x)} 0 0 0 0 {num(h - x)} Z")(r("adj", 16667)),
        "pie": lambda: _pie(w, h, given.get("adj1", 0), given.get("adj2", 16200000), "wedge"),
        "chord": lambda: _pie(w, h, given.get("adj1", 2700000), given.get("adj2", 16200000), "chord"),
        "arc": lambda: _pie(w, h, given.get("adj1", 16200000), given.get("adj2", 0), "open"),
        "flowChartManualOperation": lambda: polygon([(0, 0), (w, 0), (w * 4 / 5, h), (w / 5, h)]),
        "flowChartManualInput": lambda: polygon([(0, h / 5), (w, 0), (w, h), (0, h)]),
        "flowChartInputOutput": lambda: polygon([(w / 5, 0), (w, 0), (w * 4 / 5, h), (0, h)]),
        "flowChartPreparation": lambda: polygon([(w / 5, 0), (w * 4 / 5, 0), (w, h / 2), (w * 4 / 5, h), (w / 5, h), (0, h / 2)]),
        "flowChartMerge": lambda: polygon([(0, 0), (w, 0), (w / 2, h)]),
        "flowChartPunchedCard": lambda: polygon([(w / 5, 0), (w, 0), (w, h), (0, h), (0, h / 5)]),
        "flowChartOffpageConnector": lambda: polygon([(0, 0), (w, 0), (w, h * 4 / 5), (w / 2, h), (0, h * 4 / 5)]),
        "flowChartCollate": lambda: polygon([(0, 0), (w, 0), (w / 2, h / 2), (w, h), (0, h), (w / 2, h / 2)]),
    }
    same = {"flowChartConnector": "ellipse", "flowChartDecision": "diamond", "flowChartExtract": "triangle", "straightConnector1": "line", "flowChartAlternateProcess": "roundRect", "flowChartProcess": "rect"}
    name = same.get(name, name)
    if name == "rect":
        return polygon([(0, 0), (w, 0), (w, h), (0, h)]), True
    if name in POLYGONS:
        return _inscribed(POLYGONS[name], w, h), True
    if name in STARS:
        n, inner = STARS[name]
        return _inscribed(n, w, h, given.get("adj", inner)), True
    if name in shapes:
        return shapes[name](), True
    if (drawn := outline(name, w, h, given)) is not None:
        return drawn, True
    return polygon([(0, 0), (w, 0), (w, h), (0, h)]), False


def _pie(w: float, h: float, start: float, end: float, kind: str) -> str:
    """From one angle to another (60000ths of a degree, clockwise from the right)."""
    a, b = math.radians(start / 60000), math.radians(end / 60000)
    at = lambda t: (w / 2 + w / 2 * math.cos(t), h / 2 + h / 2 * math.sin(t))
    (x0, y0), (x1, y1) = at(a), at(b)
    large = int(((end - start) % 21600000) > 10800000)
    arc = f"A {num(w / 2)} {num(h / 2)} 0 {large} 1 {num(x1)} {num(y1)}"
    return f"M {num(x0)} {num(y0)} {arc}" + {"wedge": f" L {num(w / 2)} {num(h / 2)} Z", "chord": " Z", "open": ""}[kind]


class Guides:
    """The guide language of custom geometry: named formulas over built-in names, resolved when asked for. Cycles and depths over 256 give 0."""

    def __init__(self, w: float, h: float, formulas: list[tuple[str, str]]):
        s, b = min(w, h), max(w, h)
        self.values: dict[str, float] = {"w": w, "h": h, "l": 0, "t": 0, "r": w, "b": h, "ss": s, "ls": b, "hc": w / 2, "vc": h / 2, "cd2": 10800000, "cd4": 5400000, "cd8": 2700000, "3cd4": 16200000, "3cd8": 8100000, "5cd8": 13500000, "7cd8": 18900000}
        self.values |= {f"wd{n}": w / n for n in (2, 3, 4, 5, 6, 8, 10, 12, 32)} | {f"hd{n}": h / n for n in (2, 3, 4, 5, 6, 8, 10)} | {f"ssd{n}": s / n for n in (2, 4, 6, 8, 16, 32)}
        self.formulas = dict(formulas)
        self.open: set[str] = set()

    def get(self, name: str, depth: int = 0) -> float:
        try:
            x = float(name)
            return x if math.isfinite(x) else 0.0
        except ValueError:
            pass
        if name in self.formulas and name not in self.open and depth <= 256:
            self.open.add(name)
            try:
                return self.evaluate(self.formulas[name], depth + 1)
            finally:
                self.open.discard(name)
        return self.values.get(name, 0.0)

    def evaluate(self, formula: str, depth: int = 0) -> float:
        op, *names = formula.split() or ["val"]
        v = [self.get(n, depth) for n in names] + [0.0, 0.0, 0.0]
        x, y, z = v[:3]
        rad = lambda a: math.radians(a / 60000)
        try:
            return {
                "val": lambda: x, "abs": lambda: abs(x), "sqrt": lambda: math.sqrt(max(0.0, x)), "max": lambda: max(x, y), "min": lambda: min(x, y),
                "*/": lambda: x * y / z if z else 0.0, "+-": lambda: x + y - z, "+/": lambda: (x + y) / z if z else 0.0, "?:": lambda: y if x > 0 else z,
                "sin": lambda: x * math.sin(rad(y)), "cos": lambda: x * math.cos(rad(y)), "tan": lambda: x * math.tan(rad(y)), "at2": lambda: math.degrees(math.atan2(y, x)) * 60000,
                "cat2": lambda: x * math.cos(math.atan2(z, y)), "sat2": lambda: x * math.sin(math.atan2(z, y)), "mod": lambda: math.sqrt(x * x + y * y + z * z), "pin": lambda: max(x, min(y, z)),
            }[op]()
        except (KeyError, OverflowError, ValueError):
            return 0.0


def custom_path(geometry, w: float, h: float) -> tuple[str, bool]:
    """The path of a custGeom element scaled to w by h points, and whether none of its paths is filled."""
    formulas = [(g.attrs.get("name", ""), g.attrs.get("fmla", "val 0")) for tag in ("a:avLst", "a:gdLst") for lst in geometry.all(tag) for g in lst.all("a:gd")]
    out, filled = [], False
    lst = geometry.child("a:pathLst")
    for path in lst.all("a:path") if lst else []:
        pw, ph = (Guides(0, 0, []).get(path.attrs.get(k) or "0") for k in ("w", "h"))
        sx, sy = (w / pw if pw else w / (w * 12700 or 1)), (h / ph if ph else h / (h * 12700 or 1))
        g = Guides(pw or w * 12700, ph or h * 12700, formulas)
        filled |= path.attrs.get("fill") != "none"
        x = y = 0.0
        for step in path.children:
            pts = [(g.get(p.attrs.get("x", "0")), g.get(p.attrs.get("y", "0"))) for p in step.all("a:pt")]
            xy = " ".join(f"{num(px * sx)} {num(py * sy)}" for px, py in pts)
            kind = step.tag.rpartition(":")[2]
            if kind == "close":
                out.append("Z")
            elif kind == "arcTo":
                rx, ry, a0, sweep = (g.get(step.attrs.get(k, "0")) for k in ("wR", "hR", "stAng", "swAng"))
                t0, t1 = math.radians(a0 / 60000), math.radians((a0 + sweep) / 60000)
                x, y = x - rx * math.cos(t0) + rx * math.cos(t1), y - ry * math.sin(t0) + ry * math.sin(t1)
                out.append(f"A {num(rx * sx)} {num(ry * sy)} 0 {int(abs(sweep) > 10800000)} {int(sweep > 0)} {num(x * sx)} {num(y * sy)}")
            elif pts:
                out.append({"moveTo": "M", "lnTo": "L", "cubicBezTo": "C", "quadBezTo": "Q"}.get(kind, "L") + f" {xy}")
            if pts:
                x, y = pts[-1]
    return " ".join(out), not filled


#: Names of outlines by their number of corners; those whose edges are joined by curves, by the number of lines.
CORNERS = {3: "triangle", 5: "pentagon", 6: "hexagon", 7: "heptagon", 8: "octagon", 10: "decagon", 12: "dodecagon"}
ROUNDED = {3: "triangle", 4: "roundRect", 5: "pentagon", 6: "hexagon", 7: "heptagon", 8: "octagon"}


def classify(geometry) -> str:
    """A name for a custGeom element that has one closed path: by its corners, by its lines if curves join them, `ellipse` for arcs alone or four curves that touch every side; else `custom`."""
    lst = geometry.child("a:pathLst")
    paths = lst.all("a:path") if lst else []
    size = [p.attrs.get(k, "") for p in paths[:1] for k in ("w", "h")]
    if len(paths) != 1 or not all(re.fullmatch(r"[0-9]{1,15}", v) and int(v) for v in size):
        return "custom"
    w, h = map(int, size)
    g = Guides(w, h, [(x.attrs.get("name", ""), x.attrs.get("fmla", "val 0")) for tag in ("a:avLst", "a:gdLst") for one in geometry.all(tag) for x in one.all("a:gd")])
    steps = [s for s in paths[0].children if s.tag in ("a:moveTo", "a:lnTo", "a:cubicBezTo", "a:quadBezTo", "a:arcTo", "a:close")]
    kinds = [s.tag[2:] for s in steps]
    points = [[(g.get(p.attrs.get("x", "0")), g.get(p.attrs.get("y", "0"))) for p in s.all("a:pt")] for s in steps]
    flat = any(k == "arcTo" and (g.get(s.attrs.get("wR", "0")) <= 0 or g.get(s.attrs.get("hR", "0")) <= 0 or g.get(s.attrs.get("swAng", "0")) == 0) for k, s in zip(kinds, steps, strict=True))
    if not kinds or kinds[0] != "moveTo" or "moveTo" in kinds[1:] or kinds[-1] != "close" or "close" in kinds[:-1] or flat or any(k.endswith("To") and k != "arcTo" and not p for k, p in zip(kinds, points, strict=True)):
        return "custom"
    lines, curves, arcs = kinds.count("lnTo"), kinds.count("cubicBezTo") + kinds.count("quadBezTo"), kinds.count("arcTo")
    ends = [p[-1] for k, p in zip(kinds, points, strict=True) if k == "cubicBezTo" and len(p) == 3]
    if lines == 0:
        sides = (any(abs(y) < h / 10 for _, y in ends), any(abs(y - h) < h / 10 for _, y in ends), any(abs(x) < w / 10 for x, _ in ends), any(abs(x - w) < w / 10 for x, _ in ends))
        return "ellipse" if arcs >= 2 or curves == 4 and all(sides) else "custom"
    if curves or arcs:
        return ROUNDED.get(lines, "custom") if 0 < curves <= lines else "custom"
    corners = list(dict.fromkeys(p[0] for k, p in zip(kinds, points, strict=True) if k in ("moveTo", "lnTo")))
    return _four_sided(corners) if len(corners) == 4 else CORNERS.get(len(corners), "custom")


def _four_sided(p: list[tuple[float, float]]) -> str:
    edges = [(p[(i + 1) % 4][0] - p[i][0], p[(i + 1) % 4][1] - p[i][1]) for i in range(4)]
    if all((dx == 0) != (dy == 0) for dx, dy in edges) and edges[0][0] * edges[1][0] == edges[0][1] * edges[1][1] == 0 and edges[0] == (-edges[2][0], -edges[2][1]):
        return "rect"
    if len({dx * dx + dy * dy for dx, dy in edges}) == 1:
        return "rhombus"
    parallel = [edges[i][0] * edges[i + 2][1] == edges[i][1] * edges[i + 2][0] for i in (0, 1)]
    return "parallelogram" if all(parallel) else "trapezoid" if any(parallel) else "custom"
