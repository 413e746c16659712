"""Outlines of preset shapes by their published definitions: adjustments in 100000ths, lengths in shares of the box or of its smaller side, arcs by radii and angles."""

from __future__ import annotations

import math
from collections.abc import Callable

from .ooxml import js_number, to_fixed

# Outlines whose corners are given in units of the box (units, then paths of x y; a path ends with ; or, closed, with z), and default adjustments.
DRAWN = {
    "lightningBolt": "21600 8472 0 12860 6080 11050 6797 16577 12007 14767 12877 21600 21600 10012 14915 12222 13987 5022 9705 7602 8382 0 3890 z",
    "irregularSeal1": "21600 10800 5800 14522 0 14155 5325 18380 4457 16702 7315 21097 8137 17607 10475 21600 13290 16837 12942 18145 18095 14020 14457 13247 19737 10532 14935 8485 21600 7715 15627 4762 17617 5667 13937 135 14587 3722 11775 0 8615 4627 7617 370 2295 7312 6320 8352 2295 z",
    "irregularSeal2": "21600 11462 4342 14790 0 14525 5777 18007 3172 16380 6532 21600 6645 16985 9402 18270 11290 16380 12310 18877 15632 14640 14350 14942 17370 12180 15935 11612 18842 9872 17370 8700 19712 7527 18125 4917 21600 4805 18240 1285 17825 3330 15370 0 12877 3935 11592 1172 8270 5372 7817 4502 3625 8550 6382 9722 1887 z",
    "flowChartPredefinedProcess": "8 0 0 8 0 8 8 0 8 z 1 0 1 8 ; 7 0 7 8 ;", "flowChartInternalStorage": "8 0 0 8 0 8 8 0 8 z 1 0 1 8 ; 0 1 8 1 ;", "flowChartSort": "2 0 1 1 0 2 1 1 2 z 0 1 2 1 ;", "flowChartOfflineStorage": "10 0 0 10 0 5 10 z 4 8 6 8 ;", "chartPlus": "2 1 0 1 2 ; 0 1 2 1 ;", "chartX": "1 0 0 1 1 ; 0 1 1 0 ;", "chartStar": "2 0 0 2 2 ; 0 2 2 0 ; 1 0 1 2 ;",
}
CALLOUT = {1: (18750, -8333, 112500, -38333), 2: (18750, -8333, 18750, -16667, 112500, -46667), 3: (18750, -8333, 18750, -16667, 100000, -16667, 112963, -8333)}
#: Arcs of a cloud: radii in 43200ths of the box, start and sweep in 60000ths of a degree, from (3900, 14370).
CLOUD = ((6753, 9190, -11429249, 7426832), (5333, 7267, -8646143, 5396714), (4365, 5945, -8748475, 5983381), (4857, 6595, -7859164, 7034504), (5333, 7273, -4722533, 6541615), (6775, 9220, -2776035, 7816140), (5785, 7867, 37501, 6842000), (6752, 9215, 1347096, 6910353), (7720, 10543, 3974558, 4542661), (4360, 5918, -16496525, 8804134), (4345, 5945, -14809710, 9151131))
# End of fixed values.


class Pen:
    """Builds a path; arcs start where the pen stands."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.x = self.y = 0.0

    def _to(self, letter: str, *xy: float) -> Pen:
        self.out.append(f"{letter} " + " ".join(js_number(to_fixed(v)) for v in xy))
        self.x, self.y = xy[-2:]
        return self

    def m(self, x: float, y: float) -> Pen:
        return self._to("M", x, y)

    def l(self, *xy: float) -> Pen:  # noqa: E743
        for i in range(0, len(xy), 2):
            self._to("L", *xy[i : i + 2])
        return self

    def c(self, *xy: float) -> Pen:
        return self._to("C", *xy)

    def q(self, *xy: float) -> Pen:
        return self._to("Q", *xy)

    def arc(self, rx: float, ry: float, start: float, sweep: float) -> Pen:
        """An arc of an ellipse from one angle over others, in degrees, clockwise."""
        if abs(sweep) >= 360:
            return self.arc(rx, ry, start, math.copysign(180, sweep)).arc(rx, ry, start + 180, math.copysign(180, sweep))
        a, b = math.radians(start), math.radians(start + sweep)
        x, y = self.x + rx * (math.cos(b) - math.cos(a)), self.y + ry * (math.sin(b) - math.sin(a))
        self.out.append(f"A {js_number(to_fixed(rx))} {js_number(to_fixed(ry))} 0 {int(abs(sweep) > 180)} {int(sweep > 0)} {js_number(to_fixed(x))} {js_number(to_fixed(y))}")
        self.x, self.y = x, y
        return self

    def z(self) -> Pen:
        self.out.append("Z")
        return self

    def oval(self, cx: float, cy: float, rx: float, ry: float) -> Pen:
        return self.m(cx - rx, cy).arc(rx, ry, 180, 360).z()

    def box(self, x0: float, y0: float, x1: float, y1: float) -> Pen:
        return self.m(x0, y0).l(x1, y0, x1, y1, x0, y1).z()


class Box:
    """What the definitions compute with: the box's width and height, its smaller side, centre, and the adjustments."""

    def __init__(self, w: float, h: float, given: dict[str, float]):
        self.w, self.h, self.s, self.cx, self.cy, self.given = w, h, min(w, h), w / 2, h / 2, given

    def adj(self, n: int, default: float, most: float | None = 50000, least: float | None = 0) -> float:
        """The n-th adjustment, pinned."""
        v = self.given.get(f"adj{n}", self.given.get("adj", default) if n == 1 else default)
        v = v if most is None else min(v, most)
        return v if least is None else max(v, least)

    def part(self, a: float) -> float:
        """A share of the smaller side."""
        return self.s * a / 100000


def _drawn(p: Pen, b: Box, text: str) -> None:
    unit, *rest = text.split()
    n, first = float(unit), True
    xy: list[float] = []
    for t in rest:
        if t in "z;":
            if t == "z":
                p.z()
            first = True
            continue
        xy.append(float(t))
        if len(xy) == 2:
            (p.m if first else p.l)(xy[0] * b.w / n, xy[1] * b.h / n)
            first = False
            xy.clear()


def _turned(draw: Callable[[Pen, Box], None], turn: str) -> Callable[[Pen, Box], None]:
    """The outline of `draw`, which points to the right, turned to l, u or d."""

    def run(p: Pen, b: Box) -> None:
        inner = Pen()
        draw(inner, Box(b.w, b.h, b.given) if turn in "rl" else Box(b.h, b.w, b.given))
        for step in inner.out:
            letter, *v = step.split()
            if letter == "Z":
                p.z()
                continue
            x, y = float(v[0]), float(v[1])
            (p.m if letter == "M" else p.l)(*{"r": (x, y), "l": (b.w - x, y), "d": (y, x), "u": (y, b.h - x)}[turn])

    return run


def _arrow_callout(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000, 50000 * b.h / b.s)
    a1, a3 = b.adj(1, 25000, 2 * a2), b.adj(3, 25000, 100000 * b.w / b.s)
    x2, x3 = b.w * b.adj(4, 64977, 100000 - a3 * b.s / b.w) / 100000, b.w - b.part(a3)
    wide, thin = b.part(a2), b.part(a1) / 2
    p.m(0, 0).l(x2, 0, x2, b.cy - thin, x3, b.cy - thin, x3, b.cy - wide, b.w, b.cy, x3, b.cy + wide, x3, b.cy + thin, x2, b.cy + thin, x2, b.h, 0, b.h).z()


def _two_arrow_callout(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000, 50000 * b.h / b.s)
    a1, a3 = b.adj(1, 25000, 2 * a2), b.adj(3, 25000, 50000 * b.w / b.s)
    half = b.w * b.adj(4, 48123, 100000 - a3 * b.s / (b.w / 2)) / 200000
    x1, x2, x3, wide, thin = b.part(a3), b.cx - half, b.cx + half, b.part(a2), b.part(a1) / 2
    x4 = b.w - x1
    p.m(0, b.cy).l(x1, b.cy - wide, x1, b.cy - thin, x2, b.cy - thin, x2, 0, x3, 0, x3, b.cy - thin, x4, b.cy - thin, x4, b.cy - wide, b.w, b.cy, x4, b.cy + wide, x4, b.cy + thin, x3, b.cy + thin, x3, b.h, x2, b.h, x2, b.cy + thin, x1, b.cy + thin, x1, b.cy + wide).z()


def _quad_callout(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 18515)
    a1, a3 = b.adj(1, 18515, 2 * a2), b.adj(3, 18515, 50000 - a2)
    a4 = b.adj(4, 48123, 100000 - 2 * a3, a1)
    head, wide, thin, bx, by = b.part(a3), b.part(a2), b.part(a1) / 2, b.w * a4 / 200000, b.h * a4 / 200000
    x, y = b.cx, b.cy
    p.m(0, y).l(head, y - wide, head, y - thin, x - bx, y - thin, x - bx, y - by, x - thin, y - by, x - thin, head, x - wide, head, x, 0, x + wide, head, x + thin, head, x + thin, y - by, x + bx, y - by, x + bx, y - thin, b.w - head, y - thin, b.w - head, y - wide, b.w, y)
    p.l(b.w - head, y + wide, b.w - head, y + thin, x + bx, y + thin, x + bx, y + by, x + thin, y + by, x + thin, b.h - head, x + wide, b.h - head, x, b.h, x - wide, b.h - head, x - thin, b.h - head, x - thin, y + by, x - bx, y + by, x - bx, y + thin, head, y + thin, head, y + wide).z()


def _quad_arrow(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 22500)
    a1, a3 = b.adj(1, 22500, 2 * a2), b.adj(3, 22500, (100000 - 2 * a2) / 2)
    n, wide, thin, x, y = b.part(a3), b.part(a2), b.part(a1) / 2, b.cx, b.cy
    p.m(0, y).l(n, y - wide, n, y - thin, x - thin, y - thin, x - thin, n, x - wide, n, x, 0, x + wide, n, x + thin, n, x + thin, y - thin, b.w - n, y - thin, b.w - n, y - wide, b.w, y, b.w - n, y + wide, b.w - n, y + thin, x + thin, y + thin, x + thin, b.h - n, x + wide, b.h - n, x, b.h, x - wide, b.h - n, x - thin, b.h - n, x - thin, y + thin, n, y + thin, n, y + wide).z()


def _left_right_up(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000)
    a1, a3 = b.adj(1, 25000, 2 * a2), b.adj(3, 25000, (100000 - 2 * a2) / 2)
    n, wide, thin, x = b.part(a3), b.part(a2), b.part(a1) / 2, b.cx
    top, mid = b.h - 2 * wide, b.h - wide
    p.m(0, mid).l(n, top, n, mid - thin, x - thin, mid - thin, x - thin, n, x - wide, n, x, 0, x + wide, n, x + thin, n, x + thin, mid - thin, b.w - n, mid - thin, b.w - n, top, b.w, mid, b.w - n, b.h, b.w - n, mid + thin, n, mid + thin, n, b.h).z()


def _left_up(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000)
    a1, a3 = b.adj(1, 25000, 2 * a2), b.adj(3, 25000, 100000 - 2 * a2)
    n, wide, thin = b.part(a3), b.part(a2), b.part(a1) / 2
    x, y = b.w - wide, b.h - wide
    p.m(0, y).l(n, b.h - 2 * wide, n, y - thin, x - thin, y - thin, x - thin, n, b.w - 2 * wide, n, x, 0, b.w, n, x + thin, n, x + thin, y + thin, n, y + thin, n, b.h).z()


def _bent_up(p: Pen, b: Box) -> None:
    thick, wide, n = b.part(b.adj(1, 25000)), b.part(b.adj(2, 25000)), b.part(b.adj(3, 25000))
    x = b.w - wide
    p.m(0, b.h - thick).l(x - thick / 2, b.h - thick, x - thick / 2, n, b.w - 2 * wide, n, x, 0, b.w, n, x + thick / 2, n, x + thick / 2, b.h, 0, b.h).z()


def _bent(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000)
    thick, wide, n = b.part(b.adj(1, 25000, 2 * a2)), b.part(a2), b.part(b.adj(3, 25000))
    off, x = wide - thick / 2, b.w - n
    turn = b.part(b.adj(4, 43750, 100000 * min(x, b.h - off) / b.s))
    inner = max(turn - thick, 0)
    p.m(0, b.h).l(0, off + turn).arc(turn, turn, 180, 90).l(x, off, x, 0, b.w, wide, x, 2 * off + thick, x, off + thick, thick + inner, off + thick).arc(inner, inner, 270, -90).l(thick, b.h).z()


def _uturn(p: Pen, b: Box) -> None:
    a2 = b.adj(2, 25000, 25000)
    a1 = b.adj(1, 25000, 2 * a2)
    a3 = b.adj(3, 25000, (100000 - a1 * b.s / b.h) * b.h / b.s)
    tip = b.h * b.adj(5, 75000, 100000, (a3 + a1) * b.s / b.h) / 100000
    thick, wide = b.part(a1), b.part(a2)
    off, y = wide - thick / 2, tip - b.part(a3)
    x9, x8 = b.w - off, b.w - wide
    turn = b.part(b.adj(4, 43750, min(x9 / 2, y) * 100000 / b.s))
    inner, x7 = max(turn - thick, 0), x8 - wide + off
    p.m(0, b.h).l(0, turn).arc(turn, turn, 180, 90).l(x9 - turn, 0).arc(turn, turn, 270, 90).l(x9, y, b.w, y, x8, tip, x8 - wide, y, x7, y, x7, thick + inner).arc(inner, inner, 0, -90).l(thick + inner, thick).arc(inner, inner, 270, -90).l(thick, b.h).z()


def _striped(p: Pen, b: Box) -> None:
    x, thin = b.w - b.part(b.adj(2, 50000, 84375 * b.w / b.s)), b.h * b.adj(1, 50000, 100000) / 200000
    y1, y2 = b.cy - thin, b.cy + thin
    p.box(0, y1, b.s / 32, y2).box(b.s / 16, y1, b.s / 8, y2).m(b.s * 5 / 32, y1).l(x, y1, x, 0, b.w, b.cy, x, b.h, x, y2, b.s * 5 / 32, y2).z()


def _notched(p: Pen, b: Box) -> None:
    n, thin = b.part(b.adj(2, 50000, 100000 * b.w / b.s)), b.h * b.adj(1, 50000, 100000) / 200000
    x = b.w - n
    p.m(0, b.cy - thin).l(x, b.cy - thin, x, 0, b.w, b.cy, x, b.h, x, b.cy + thin, 0, b.cy + thin, thin * n / b.cy, b.cy).z()


def _wedge(p: Pen, b: Box, corner: float) -> None:
    """A rectangle, its corners rounded, with a pointer from the side that faces the tip."""
    dx, dy = b.w * b.adj(1, -20833, None, None) / 100000, b.h * b.adj(2, 62500, None, None) / 100000
    tip = b.cx + dx, b.cy + dy
    upright = abs(dy) > abs(dx * b.h / b.w)
    x1, x2 = (b.w * k / 12 for k in ((7, 10) if dx > 0 else (2, 5)))
    y1, y2 = (b.h * k / 12 for k in ((7, 10) if dy > 0 else (2, 5)))
    at = "b" if upright and dy > 0 else "t" if upright else "r" if dx > 0 else "l"
    turn = lambda start: p.arc(corner, corner, start, 90) if corner else p
    p.m(0, corner)
    turn(180).l(*(x1, 0, *tip, x2, 0) if at == "t" else (), b.w - corner, 0)
    turn(270).l(*(b.w, y1, *tip, b.w, y2) if at == "r" else (), b.w, b.h - corner)
    turn(0).l(*(x2, b.h, *tip, x1, b.h) if at == "b" else (), corner, b.h)
    turn(90).l(*(0, y2, *tip, 0, y1) if at == "l" else ()).z()


def _wedge_oval(p: Pen, b: Box) -> None:
    dx, dy = b.w * b.adj(1, -20833, None, None) / 100000, b.h * b.adj(2, 62500, None, None) / 100000
    toward = math.atan2(dy * b.w, dx * b.h)
    ends = [(b.cx * math.cos(a), b.cy * math.sin(a)) for a in (toward + math.radians(11), toward - math.radians(11))]
    start, stop = (math.degrees(math.atan2(y / b.cy, x / b.cx)) for x, y in ends)
    p.m(b.cx + dx, b.cy + dy).l(b.cx + ends[0][0], b.cy + ends[0][1]).arc(b.cx, b.cy, start, (stop - start) % 360).z()


def _callout(n: int, border: bool, accent: bool) -> Callable[[Pen, Box], None]:
    def run(p: Pen, b: Box) -> None:
        a = [b.adj(i + 1, d, None, None) / 100000 for i, d in enumerate(CALLOUT[n])]
        p.box(0, 0, b.w, b.h)
        if accent:
            p.m(a[1] * b.w, 0).l(a[1] * b.w, b.h)
        p.m(a[1] * b.w, a[0] * b.h).l(*(v for i in range(2, len(a), 2) for v in (a[i + 1] * b.w, a[i] * b.h)))

    return run


def _brace(p: Pen, b: Box, right: bool) -> None:
    a2 = b.adj(2, 50000, 100000)
    y1, y3 = b.part(b.adj(1, 8333, min(100000 - a2, a2) / 2 * b.h / b.s)), b.h * a2 / 100000
    if right:
        p.m(0, 0).arc(b.cx, y1, 270, 90).l(b.cx, y3 - y1).arc(b.cx, y1, 180, -90).arc(b.cx, y1, 270, -90).l(b.cx, b.h - y1).arc(b.cx, y1, 0, 90)
    else:
        p.m(b.w, b.h).arc(b.cx, y1, 90, 90).l(b.cx, y3 + y1).arc(b.cx, y1, 0, -90).arc(b.cx, y1, 90, -90).l(b.cx, y1).arc(b.cx, y1, 180, 90)


def _brace_pair(p: Pen, b: Box) -> None:
    x = b.part(b.adj(1, 8333, 25000))
    p.m(2 * x, b.h).arc(x, x, 90, 90).l(x, b.cy + x).arc(x, x, 0, -90).arc(x, x, 90, -90).l(x, x).arc(x, x, 180, 90)
    p.m(b.w - 2 * x, 0).arc(x, x, 270, 90).l(b.w - x, b.cy - x).arc(x, x, 180, -90).arc(x, x, 270, -90).l(b.w - x, b.h - x).arc(x, x, 0, 90)


def _bracket(p: Pen, b: Box, right: bool) -> None:
    y = b.part(b.adj(1, 8333, 50000 * b.h / b.s))
    if right:
        p.m(0, 0).arc(b.w, y, 270, 90).l(b.w, b.h - y).arc(b.w, y, 0, 90)
    else:
        p.m(b.w, b.h).arc(b.w, y, 90, 90).l(0, y).arc(b.w, y, 180, 90)


def _bracket_pair(p: Pen, b: Box) -> None:
    x = b.part(b.adj(1, 16667))
    p.m(x, b.h).arc(x, x, 90, 90).l(0, x).arc(x, x, 180, 90).m(b.w - x, 0).arc(x, x, 270, 90).l(b.w, b.h - x).arc(x, x, 0, 90)


def _block_arc(p: Pen, b: Box) -> None:
    start, stop = (b.given.get(f"adj{n}", d) / 60000 for n, d in ((1, 10800000), (2, 0)))
    sweep = (stop - start) % 360 or 360
    d = b.part(b.adj(3, 25000))
    at = lambda t, rx, ry: (b.cx + rx * math.cos(math.radians(t)), b.cy + ry * math.sin(math.radians(t)))
    p.m(*at(start, b.cx, b.cy)).arc(b.cx, b.cy, start, sweep).l(*at(start + sweep, b.cx - d, b.cy - d)).arc(b.cx - d, b.cy - d, start + sweep, -sweep).z()


def _no_smoking(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 18750))
    rx, ry, slope = b.cx - d, b.cy - d, math.atan2(b.h, b.w)
    radius = lambda t: rx * ry / (math.hypot(ry * math.cos(t), rx * math.sin(t)) or 1)
    half = math.atan2(d / 2, radius(slope))
    t = slope - half
    x, y = radius(t) * math.cos(t), radius(t) * math.sin(t)
    p.oval(b.cx, b.cy, b.cx, b.cy)
    for sign, start in ((1, math.degrees(t)), (-1, math.degrees(t) - 180)):
        p.m(b.cx + sign * x, b.cy + sign * y).arc(rx, ry, start, -180 + math.degrees(2 * half)).z()


def _sun(p: Pen, b: Box) -> None:
    a = b.adj(1, 25000, 46875, 12500)
    g = 50000 - a
    g5, g6 = 50000 - g * 30274 / 32768, 50000 - g * 12540 / 32768
    near, far = g5 * 3 / 4, g6 * 3 / 4
    n = (near, near + 3662, far + 3662, far + 12500)
    x = [b.w * v / 100000 for v in n], [b.w * (100000 - v) / 100000 for v in n]
    y = [b.h * v / 100000 for v in n], [b.h * (100000 - v) / 100000 for v in n]
    ox, oy = (b.w * 18436 / 21600, b.w * 3163 / 21600), (b.h * 3163 / 21600, b.h * 18436 / 21600)
    for tip, one, two in (((b.w, b.cy), (x[1][0], y[1][3]), (x[1][0], y[0][3])), ((ox[0], oy[0]), (x[1][1], y[0][2]), (x[1][2], y[0][1])), ((b.cx, 0), (x[1][3], y[0][0]), (x[0][3], y[0][0])), ((ox[1], oy[0]), (x[0][2], y[0][1]), (x[0][1], y[0][2])),
                          ((0, b.cy), (x[0][0], y[0][3]), (x[0][0], y[1][3])), ((ox[1], oy[1]), (x[0][1], y[1][2]), (x[0][2], y[1][1])), ((b.cx, b.h), (x[0][3], y[1][0]), (x[1][3], y[1][0])), ((ox[0], oy[1]), (x[1][2], y[1][1]), (x[1][1], y[1][2]))):
        p.m(*tip).l(*one, *two).z()
    p.m(b.w * a / 100000, b.cy).arc(b.w * g / 100000, b.h * g / 100000, 180, 360).z()


def _wave(p: Pen, b: Box, waves: int) -> None:
    y1 = b.h * b.adj(1, 12500 if waves == 1 else 6250, 20000 if waves == 1 else 12500) / 100000
    shift = b.w * b.adj(2, 0, 10000, -10000) / 50000
    up, y2 = y1 * 10 / 3, b.h - y1
    left, right = -min(shift, 0), b.w - max(shift, 0)
    step = (right - left) / waves
    p.m(left, y1)
    for i in range(waves):
        x = left + i * step
        p.c(x + step / 3, y1 - up, x + step * 2 / 3, y1 + up, x + step, y1)
    first = b.w - left
    p.l(first, y2)
    for i in range(waves):
        x = first - i * step
        p.c(x - step / 3, y2 + up, x - step * 2 / 3, y2 - up, x - step, y2)
    p.z()


def _scroll(p: Pen, b: Box) -> None:
    """A sheet that rolls up above and below."""
    d = b.part(b.adj(1, 12500, 25000))
    r = d / 2
    p.m(d, b.h - d).l(d, r).arc(r, r, 180, 90).l(b.w - r, 0).arc(r, r, 270, 180).l(b.w - d, d, b.w - d, b.h - r).arc(r, r, 0, 90).l(r, b.h).arc(r, r, 90, 180).z()
    p.m(3 * r, 0).arc(r, r, 270, 180).arc(r / 2, r / 2, 90, 180).l(2 * d, r).m(b.w - d, d).l(3 * r, d).m(r, b.h - d).arc(r / 2, r / 2, 270, 180).l(d, b.h - r).m(r, b.h).arc(r, r, 90, -90).l(d, b.h - d)


def _scroll_aside(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 12500, 25000))
    r = d / 2
    p.m(b.w - d, d).l(b.w - d, r).arc(r, r, 180, 180).l(b.w, b.h - d - r).arc(r, r, 0, 90).l(d, b.h - d, d, b.h - r).arc(r, r, 0, 180).l(0, d + r).arc(r, r, 180, 90).z()
    p.m(b.w - d, d).l(b.w - r, d).arc(r, r, 90, -90).m(b.w - r, d).l(b.w - r, r).arc(r / 2, r / 2, 0, 180).m(r, 2 * d).l(r, d + r).arc(r / 2, r / 2, 180, 180).arc(r, r, 0, 180).m(d, d + r).l(d, b.h - d)


def _multiply(p: Pen, b: Box) -> None:
    thick, a, long = b.part(b.adj(1, 23520, 51965)), math.atan2(b.h, b.w), math.hypot(b.w, b.h)
    sa, ca = math.sin(a), math.cos(a)
    xm, ym = ca * long * 0.48035 / 2, sa * long * 0.48035 / 2
    xa, ya, xb, yb = xm - sa * thick / 2, ym + ca * thick / 2, xm + sa * thick / 2, ym - ca * thick / 2
    yc, dx = yb + (b.cx - xb) * sa / ca, (b.cy - ya) * ca / sa
    p.m(xa, ya).l(xb, yb, b.cx, yc, b.w - xb, yb, b.w - xa, ya, b.w - xa - dx, b.cy, b.w - xa, b.h - ya, b.w - xb, b.h - yb, b.cx, b.h - yc, xb, b.h - yb, xa, b.h - ya, xa + dx, b.cy).z()


def _divide(p: Pen, b: Box) -> None:
    a1 = b.adj(1, 23520, 36745, 1000)
    a3 = b.adj(3, 11760, min((73490 - a1) / 4, 36745 * b.w / b.h), 1000)
    thin, gap, r, half = b.h * a1 / 200000, b.h * b.adj(2, 5880, 73490 - 4 * a3 - a1) / 100000, b.h * a3 / 100000, b.w * 73490 / 200000
    top = b.cy - thin - gap - 2 * r
    p.m(b.cx, top).arc(r, r, 270, 360).z().m(b.cx, b.h - top).arc(r, r, 90, 360).z().box(b.cx - half, b.cy - thin, b.cx + half, b.cy + thin)


def _equal(p: Pen, b: Box) -> None:
    a1 = b.adj(1, 23520, 36745)
    thick, gap, half = b.h * a1 / 100000, b.h * b.adj(2, 11760, 100000 - 2 * a1) / 200000, b.w * 73490 / 200000
    p.box(b.cx - half, b.cy - gap - thick, b.cx + half, b.cy - gap).box(b.cx - half, b.cy + gap, b.cx + half, b.cy + gap + thick)


def _smiley(p: Pen, b: Box) -> None:
    a = b.adj(1, 4653, 4653, -4653)
    at = lambda x, y: (b.w * x / 21600, b.h * y / 21600)
    low = b.h * 16515 / 21600
    p.oval(b.cx, b.cy, b.cx, b.cy)
    for x in (6215, 13135):
        p.m(*at(x, 7570)).arc(*at(1125, 1125), 180, 360).z()
    p.m(b.w * 4969 / 21600, low - b.h * a / 100000).q(b.cx, low + b.h * a * 3 / 100000, b.w * 16640 / 21600, low - b.h * a / 100000)


def _tabs(p: Pen, b: Box, kind: str) -> None:
    d = math.hypot(b.w, b.h) / 20
    if kind == "square":
        for x in (0, b.w - d):
            for y in (0, b.h - d):
                p.box(x, y, x + d, y + d)
        return
    for cx, cy, start in ((0, 0, 0), (b.w, 0, 90), (b.w, b.h, 180), (0, b.h, 270)):
        sx, sy = (1 if cx == 0 else -1), (1 if cy == 0 else -1)
        one, two = ((cx + sx * d, cy), (cx, cy + sy * d)) if start in (0, 180) else ((cx, cy + sy * d), (cx + sx * d, cy))
        p.m(cx, cy).l(*one)
        (p.arc(d, d, start, 90) if kind == "plaque" else p.l(*two)).z()


def _can(p: Pen, b: Box) -> None:
    y = b.part(b.adj(1, 25000, 50000 * b.h / b.s)) / 2
    p.m(0, y).arc(b.cx, y, 180, -180).l(b.w, b.h - y).arc(b.cx, y, 0, 180).z().m(0, y).arc(b.cx, y, 180, 180).arc(b.cx, y, 0, 180).z()


def _cloud(p: Pen, b: Box) -> None:
    p.m(b.w * 3900 / 43200, b.h * 14370 / 43200)
    for rx, ry, start, sweep in CLOUD:
        p.arc(b.w * rx / 43200, b.h * ry / 43200, start / 60000, sweep / 60000)
    p.z()


def _cloud_callout(p: Pen, b: Box) -> None:
    """A cloud and three balls towards the tip, each smaller than the one before."""
    _cloud(p, b)
    dx, dy = b.w * b.adj(1, -20833, None, None) / 100000, b.h * b.adj(2, 62500, None, None) / 100000
    long = math.hypot(dx, dy) or 1
    edge = b.cx * b.cy / (math.hypot(b.cy * dx / long, b.cx * dy / long) or 1)
    for r, share in ((b.s * 1800 / 21600, 1 / 3), (b.s * 1200 / 21600, 2 / 3), (b.s * 600 / 21600, 1)):
        t = (edge + (long - edge) * share) / long
        p.oval(b.cx + dx * t, b.cy + dy * t, r, r)


def _curve(n: int) -> Callable[[Pen, Box], None]:
    """Connectors of n curves: quarter turns between the ends and the middle lines that the adjustments place."""

    def run(p: Pen, b: Box) -> None:
        a = [b.adj(i, 50000, None, None) / 100000 for i in (1, 2, 3)]
        w, h = b.w, b.h
        p.m(0, 0)
        if n == 2:
            p.c(w / 2, 0, w, h / 2, w, h)
        elif n == 3:
            x = w * a[0]
            p.c(x / 2, 0, x, h / 4, x, h / 2).c(x, h * 3 / 4, (w + x) / 2, h, w, h)
        elif n == 4:
            x, y = w * a[0], h * a[1]
            m = (w + x) / 2
            p.c(x / 2, 0, x, y / 4, x, y / 2).c(x, y * 3 / 4, (x + m) / 2, y, m, y).c((m + w) / 2, y, w, (h + y) / 2, w, h)
        else:
            x, y, z = w * a[0], h * a[1], w * a[2]
            m, low = (x + z) / 2, (y + h) / 2
            p.c(x / 2, 0, x, y / 4, x, y / 2).c(x, y * 3 / 4, (x + m) / 2, y, m, y).c((z + m) / 2, y, z, (low + y) / 2, z, low).c(z, (low + h) / 2, (z + w) / 2, h, w, h)

    return run


def _bevel(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 12500))
    p.box(0, 0, b.w, b.h).box(d, d, b.w - d, b.h - d)
    for x, y in ((0, 0), (0, b.h), (b.w, 0), (b.w, b.h)):
        p.m(x, y).l(d if x == 0 else b.w - d, d if y == 0 else b.h - d)


def _cube(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 25000, 100000))
    p.box(0, d, b.w - d, b.h).m(0, d).l(d, 0, b.w, 0, b.w - d, d).z().m(b.w - d, d).l(b.w, 0, b.w, b.h - d, b.w - d, b.h).z()


def _folded(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 16667))
    p.m(0, 0).l(b.w, 0, b.w, b.h - d, b.w - d, b.h, 0, b.h).z().m(b.w - d, b.h).l(b.w - d * 4 / 5, b.h - d * 4 / 5, b.w, b.h - d)


def _teardrop(p: Pen, b: Box) -> None:
    a = b.adj(1, 100000, 200000) / 100000
    x, y = b.cx + b.cx * a, b.cy - b.cy * a
    p.m(0, b.cy).arc(b.cx, b.cy, 180, 90).q((b.cx + x) / 2, 0, x, y).q(b.w, (b.cy + y) / 2, b.w, b.cy).arc(b.cx, b.cy, 0, 90).arc(b.cx, b.cy, 90, 90).z()


def _tape(p: Pen, b: Box) -> None:
    a = math.degrees(math.atan2(b.h, b.w))
    p.m(b.cx, b.h).arc(b.cx, b.cy, 90, 90).arc(b.cx, b.cy, 180, 90).arc(b.cx, b.cy, 270, 90).arc(b.cx, b.cy, 0, a).l(b.w, p.y, b.w, b.h).z()


def _crossed(p: Pen, b: Box, share: float) -> None:
    p.oval(b.cx, b.cy, b.cx, b.cy)
    if share == 1:
        p.m(b.cx, 0).l(b.cx, b.h).m(0, b.cy).l(b.w, b.cy)
    else:
        x, y = b.cx * share, b.cy * share
        p.m(b.cx - x, b.cy - y).l(b.cx + x, b.cy + y).m(b.cx + x, b.cy - y).l(b.cx - x, b.cy + y)


def _moon(p: Pen, b: Box) -> None:
    d = b.part(b.adj(1, 50000, 87500)) * b.w / b.s
    # The inner edge is an arc through the ends and the point that the adjustment names.
    deep = b.w - d
    r = (deep * deep + b.w * b.w) / (2 * deep)  # in the space where both radii of the outer edge are the width
    reach = math.degrees(math.asin(min(1.0, b.w / r)))
    p.m(b.w, b.h).arc(b.w, b.cy, 90, 180).arc(r, r * b.cy / b.w, 180 + reach, -2 * reach).z()


def _button(p: Pen, b: Box, icon: str) -> None:
    """A button with a sign three quarters as large as its smaller side: arrows to a side, with a bar for the first and the last, or a sheet."""
    r = b.s * 3 / 8
    top, low, left, right = b.cy - r, b.cy + r, b.cx - r, b.cx + r
    p.box(0, 0, b.w, b.h)
    if icon == "sheet":
        half, fold = b.s * 9 / 32, b.s * 3 / 16
        x0, x1 = b.cx - half, b.cx + half
        p.m(x0, top).l(x1 - fold, top, x1, top + fold, x1, low, x0, low).z().m(x1 - fold, top).l(x1 - fold, top + fold, x1, top + fold)
        return
    bar, sign = (2 * r, 1) if icon.endswith("|") else (0, 0)
    turn = (lambda x: x) if icon[0] == ">" else (lambda x: b.w - x)  # drawn to the right, or mirrored
    p.m(turn(right - bar / 4 * sign), b.cy).l(turn(left), top, turn(left), low).z()
    if bar:
        p.m(turn(right - bar / 8), top).l(turn(right), top, turn(right), low, turn(right - bar / 8), low).z()


OUTLINES: dict[str, Callable[[Pen, Box], None]] = {
    **{n: (lambda p, b, t=t: _drawn(p, b, t)) for n, t in DRAWN.items()},
    **{f"{prefix}{n}": _callout(n, "order" in prefix, "ccent" in prefix) for prefix in ("callout", "borderCallout", "accentCallout", "accentBorderCallout") for n in (1, 2, 3)},
    **{f"curvedConnector{n}": _curve(n) for n in (2, 3, 4, 5)},
    **{f"{name}ArrowCallout": _turned(_arrow_callout, name[0]) for name in ("right", "left", "up", "down")},
    "leftRightArrowCallout": _two_arrow_callout, "upDownArrowCallout": _turned(_two_arrow_callout, "d"), "quadArrowCallout": _quad_callout, "quadArrow": _quad_arrow, "leftRightUpArrow": _left_right_up, "leftUpArrow": _left_up, "bentUpArrow": _bent_up, "bentArrow": _bent, "uturnArrow": _uturn,
    "stripedRightArrow": _striped, "notchedRightArrow": _notched, "wedgeRectCallout": lambda p, b: _wedge(p, b, 0), "wedgeRoundRectCallout": lambda p, b: _wedge(p, b, b.part(b.adj(3, 16667))), "wedgeEllipseCallout": _wedge_oval, "cloud": _cloud, "cloudCallout": _cloud_callout,
    "leftBrace": lambda p, b: _brace(p, b, False), "rightBrace": lambda p, b: _brace(p, b, True), "bracePair": _brace_pair, "leftBracket": lambda p, b: _bracket(p, b, False), "rightBracket": lambda p, b: _bracket(p, b, True), "bracketPair": _bracket_pair,
    **{f"actionButton{n}": (lambda p, b, i=i: _button(p, b, i)) for n, i in (("BackPrevious", "<"), ("ForwardNext", ">"), ("Beginning", "<|"), ("End", ">|"), ("Document", "sheet"))},
    "blockArc": _block_arc, "noSmoking": _no_smoking, "sun": _sun, "moon": _moon, "wave": lambda p, b: _wave(p, b, 1), "doubleWave": lambda p, b: _wave(p, b, 2), "verticalScroll": _scroll, "horizontalScroll": _scroll_aside, "mathMultiply": _multiply, "mathDivide": _divide, "mathEqual": _equal, "smileyFace": _smiley,
    "cornerTabs": lambda p, b: _tabs(p, b, "corner"), "squareTabs": lambda p, b: _tabs(p, b, "square"), "plaqueTabs": lambda p, b: _tabs(p, b, "plaque"), "can": _can, "cube": _cube, "bevel": _bevel, "foldedCorner": _folded, "teardrop": _teardrop,
    "heart": lambda p, b: p.m(b.cx, b.h / 4).c(b.cx + b.w * 10 / 48, -b.h / 3, b.cx + b.w * 49 / 48, b.h / 4, b.cx, b.h).c(b.cx - b.w * 49 / 48, b.h / 4, b.cx - b.w * 10 / 48, -b.h / 3, b.cx, b.h / 4).z(),
    "pieWedge": lambda p, b: p.m(0, b.h).arc(b.w, b.h, 180, 90).l(b.w, b.h).z(),
    "snipRoundRect": lambda p, b: p.m(b.part(b.adj(1, 16667)), 0).l(b.w - b.part(b.adj(2, 16667)), 0, b.w, b.part(b.adj(2, 16667)), b.w, b.h, 0, b.h, 0, b.part(b.adj(1, 16667))).arc(b.part(b.adj(1, 16667)), b.part(b.adj(1, 16667)), 180, 90).z(),
    "nonIsoscelesTrapezoid": lambda p, b: p.m(0, b.h).l(b.part(b.adj(1, 25000, 50000 * b.w / b.s)), 0, b.w - b.part(b.adj(2, 25000, 50000 * b.w / b.s)), 0, b.w, b.h).z(),
    "bentConnector4": lambda p, b: p.m(0, 0).l(b.w * b.adj(1, 50000, None, None) / 100000, 0, b.w * b.adj(1, 50000, None, None) / 100000, b.h * b.adj(2, 50000, None, None) / 100000, b.w, b.h * b.adj(2, 50000, None, None) / 100000, b.w, b.h),
    "bentConnector5": lambda p, b: p.m(0, 0).l(*(v for x, y in ((b.adj(1, 50000, None, None), 0), (b.adj(1, 50000, None, None), b.adj(2, 50000, None, None)), (b.adj(3, 50000, None, None), b.adj(2, 50000, None, None)), (b.adj(3, 50000, None, None), 100000), (100000, 100000)) for v in (b.w * x / 100000, b.h * y / 100000))),
    "flowChartDocument": lambda p, b: p.m(0, 0).l(b.w, 0, b.w, b.h * 17322 / 21600).c(b.cx, b.h * 17322 / 21600, b.cx, b.h * 23922 / 21600, 0, b.h * 20172 / 21600).z(),
    "flowChartMultidocument": lambda p, b: p.m(0, b.h * 20782 / 21600).c(b.w * 9298 / 21600, b.h * 23542 / 21600, b.w * 9298 / 21600, b.h * 18022 / 21600, b.w * 18595 / 21600, b.h * 18022 / 21600).l(b.w * 18595 / 21600, b.h * 3675 / 21600, 0, b.h * 3675 / 21600).z()
    .m(b.w * 1532 / 21600, b.h * 3675 / 21600).l(b.w * 1532 / 21600, b.h * 1815 / 21600, b.w * 20000 / 21600, b.h * 1815 / 21600, b.w * 20000 / 21600, b.h * 16252 / 21600).c(b.w * 19298 / 21600, b.h * 16252 / 21600, b.w * 18595 / 21600, b.h * 16352 / 21600, b.w * 18595 / 21600, b.h * 16352 / 21600)
    .m(b.w * 2972 / 21600, b.h * 1815 / 21600).l(b.w * 2972 / 21600, 0, b.w, 0, b.w, b.h * 14392 / 21600).c(b.w * 20800 / 21600, b.h * 14392 / 21600, b.w * 20000 / 21600, b.h * 14467 / 21600, b.w * 20000 / 21600, b.h * 14467 / 21600),
    "flowChartTerminator": lambda p, b: p.m(b.w * 3475 / 21600, 0).l(b.w * 18125 / 21600, 0).arc(b.w * 3475 / 21600, b.cy, 270, 180).l(b.w * 3475 / 21600, b.h).arc(b.w * 3475 / 21600, b.cy, 90, 180).z(),
    "flowChartPunchedTape": lambda p, b: p.m(0, b.h / 10).arc(b.w / 4, b.h / 10, 180, -180).arc(b.w / 4, b.h / 10, 180, 180).l(b.w, b.h * 9 / 10).arc(b.w / 4, b.h / 10, 0, -180).arc(b.w / 4, b.h / 10, 0, 180).z(),
    "flowChartOnlineStorage": lambda p, b: p.m(b.w / 6, 0).l(b.w, 0).arc(b.w / 6, b.cy, 270, -180).l(b.w / 6, b.h).arc(b.w / 6, b.cy, 90, 180).z(),
    "flowChartDisplay": lambda p, b: p.m(0, b.cy).l(b.w / 6, 0, b.w * 5 / 6, 0).arc(b.w / 6, b.cy, 270, 180).l(b.w / 6, b.h).z(),
    "flowChartDelay": lambda p, b: p.m(0, 0).l(b.cx, 0).arc(b.cx, b.cy, 270, 180).l(0, b.h).z(),
    "flowChartMagneticTape": _tape, "flowChartOr": lambda p, b: _crossed(p, b, 1), "flowChartSummingJunction": lambda p, b: _crossed(p, b, math.sqrt(0.5)),
    "flowChartMagneticDisk": lambda p, b: p.m(0, b.h / 6).arc(b.cx, b.h / 6, 180, 180).l(b.w, b.h * 5 / 6).arc(b.cx, b.h / 6, 0, 180).z().m(b.w, b.h / 6).arc(b.cx, b.h / 6, 0, 180),
    "flowChartMagneticDrum": lambda p, b: p.m(b.w / 6, 0).l(b.w * 5 / 6, 0).arc(b.w / 6, b.cy, 270, 180).l(b.w / 6, b.h).arc(b.w / 6, b.cy, 90, 180).z().m(b.w * 5 / 6, b.h).arc(b.w / 6, b.cy, 90, 180),
}


def outline(name: str, w: float, h: float, given: dict[str, float]) -> str | None:
    """The path of a preset, None if it isn't defined here."""
    draw = OUTLINES.get(name)
    if draw is None:
        return None
    pen = Pen()
    draw(pen, Box(w, h, given))
    return " ".join(pen.out)
