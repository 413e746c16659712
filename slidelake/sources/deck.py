"""From an open package to the tables of a deck.

Values come down levels (own element, layout placeholder, master placeholder, master styles, theme); the first level that says something wins, and an explicit "none" says something. Each table's rows carry ordinals, so they can be dealt out freely afterwards.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

from slidelake.functions import color, ooxml
from slidelake.functions.geometry import STROKE_ONLY, classify, custom_path, preset_path
from slidelake.functions.latex import latex
from slidelake.sources.package import PRESENTATION, SLIDE_TYPE, Cell, Limits, Node, Package, PackageError, Shape, open_package

# Fixed values.
CHART_KINDS = "line line3D bar bar3D pie pie3D doughnut area area3D scatter bubble radar surface surface3D stock".split()
SPEED_MS = {"slow": 1000, "med": 800, "fast": 500}
DASHES = {"solid": "0", "dash": "5", "dashDot": "5, 5, 1, 5", "dot": "1, 5", "lgDash": "10, 5", "lgDashDotDot": "10, 5, 1, 5, 1, 5", "sysDash": "5, 2", "sysDashDot": "5, 2, 1, 5", "sysDot": "2, 5"}
INSETS = {"l": 91440, "t": 45720, "r": 91440, "b": 45720}
TITLE_ROLES, SMALL_ROLES = ("title", "ctrTitle", "subTitle"), ("dt", "sldNum")
PLAYABLE = {"video": ("mp4", "webm", "ogg"), "audio": ("mp3", "wav", "ogg")}
# End of fixed values.

_COLORS = tuple(f"a:{k}" for k in ("srgbClr", "schemeClr", "scrgbClr", "prstClr", "hslClr", "sysClr"))
_INT = re.compile(r"[+-]?[0-9]{1,18}\Z")


@dataclass
class Options:
    """media: whether media bytes are kept (base64 becomes a data URL at the sink). xml: whether the node table is. tables: the names of the tables that are kept; None for all. digests: whether every part's bytes are hashed, not only media."""

    limits: Limits = field(default_factory=Limits)
    strict: bool = False
    media: bool = False
    xml: bool = False
    tables: frozenset[str] | None = None
    digests: bool = False


@dataclass
class Levels:
    """What a shape inherits from: itself, its layout's and its master's placeholder; its role; the relationships of its own part."""

    own: Node
    layout: Node | None
    master: Node | None
    role: str | None
    owner: str

    def nodes(self) -> list[Node]:
        return [n for n in (self.own, self.layout, self.master) if n is not None]


def whole(text: str | None) -> int | None:
    return int(text) if text is not None and _INT.match(text) else None


def number(text: str | None) -> float | None:
    """A finite number; None for anything else."""
    try:
        x = float(text or "")
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def boolean(text: str | None) -> bool | None:
    return None if text is None else text in ("1", "true", "on")


def _spacing(node: Node | None) -> tuple[float | None, float | None] | None:
    """A spacing as a share of lines or in points; None if it says neither, or less than nothing."""
    pct = whole(node.get("a:spcPct", "val")) if node is not None else None
    pts = whole(node.get("a:spcPts", "val")) if node is not None else None
    if pct is not None and pct >= 0:
        return pct / 100000, None
    return (None, pts / 100) if pts is not None and pts >= 0 else None


class Lists:
    """The lists that are open in HTML, outermost first; each has an open item."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def leave(self, to: int = 0) -> str:
        """Closes the lists deeper than `to`."""
        out = "".join(f"</li></{k}>" for k in reversed(self.open[to:]))
        del self.open[to:]
        return out

    def enter(self, kind: str, level: int) -> str:
        """Opens an item at a level, or as deep as one list more than are open."""
        at = min(level, len(self.open))
        out = self.leave(at + 1)
        if at < len(self.open):
            out += "</li>" if self.open[at] == kind else f"</li></{self.open.pop()}>"
        if at == len(self.open):
            self.open.append(kind)
            out += f"<{kind}>"
        return out + "<li>"


class Deck:
    """Parses one package. rows: table name -> rows, in order."""

    def __init__(self, package: Package, options: Options):
        self.p, self.o = package, options
        self.rows: dict[str, list[dict]] = {}
        self.info: dict = {}
        self.rels: dict[str, dict[str, dict]] = {}
        self.media_seen: set[str] = set()

    def keeps(self, table: str) -> bool:
        return self.o.tables is None or table in self.o.tables

    def add(self, table: str, **row: object) -> None:
        for k, v in row.items():
            if v.__class__ is float and not math.isfinite(v):
                self.p.report("non-finite-number", "warning", None, f"{table}.{k}")
                row[k] = 0.0
        if self.keeps(table):
            self.rows.setdefault(table, []).append(row)

    # Relationships and slides.

    def related(self, part: str) -> dict[str, dict]:
        """Relationships by id; of equal ids the last counts."""
        if part not in self.rels:
            self.rels[part] = {}
            for r in self.p.relationships(part):
                self.rels[part][r["rid"]] = r
                self.add("relationships", **r)
        return self.rels[part]

    def by_type(self, part: str, kind: str) -> str | None:
        found = [r["target"] for r in self.related(part).values() if r["type"] == kind and not r["is_external"]]
        return found[-1] if found else None

    def parse(self) -> None:
        p = self.p
        for name in p.names:
            info = p.archive.NameToInfo[name]
            mime = ooxml.media_type(name)
            digest = None
            if mime != "application/octet-stream" and self.o.media and (data := p.read(name, p.limits.media_bytes)) is not None:
                digest = ooxml.sha256(data)
                self.add("media", part=name, mime=mime, bytes=data)
            if self.o.digests and digest is None:
                digest = ooxml.sha256(p.archive.read(name))
            self.add("parts", part=name, ext=ooxml.extension(name), mime=mime, byte_length=info.file_size, sha256=digest)
        types = p.xml("[Content_Types].xml")
        declared = {x.attrs.get("PartName", "")[1:] for x in (types.all("Override") if types else []) if x.attrs.get("PartName", "").startswith("/") and x.attrs.get("ContentType") == SLIDE_TYPE}
        main = "ppt/presentation.xml"
        root = p.xml(main)
        rels = self.related(main)
        slides = []
        for i, s in enumerate(root.child("p:sldIdLst").all("p:sldId") if root and root.child("p:sldIdLst") else []):
            r = rels.get(s.attrs.get("r:id", ""))
            if r and r["type"] == "slide" and not r["is_external"] and r["target"] in declared:
                slides.append((i, r["target"]))
        if len(slides) > p.limits.slides:
            raise PackageError("resource-limit", f"more than {p.limits.slides} slides")
        size = root.child("p:sldSz") if root else None
        w, h = (whole(size.attrs.get(k)) or 0 if size is not None else 0 for k in ("cx", "cy"))
        if not (w > 0 and h > 0):
            w = h = 0
            p.report("invalid-slide-size", "warning", main, "the slide size is missing or not positive")
        theme = self.by_type(main, "theme")
        scheme = self.theme_colors(theme)
        accents: list[str] = []
        clr = self._scheme_node(theme)
        for i in range(1, 7):
            accent = clr.child(f"a:accent{i}") if clr else None
            if accent is None:
                break
            if v := accent.get("a:srgbClr", "val"):
                accents.append(f"#{v}")
        fonts = [f.get("p:font", "typeface") for f in (root.child("p:embeddedFontLst").children if root and root.child("p:embeddedFontLst") else [])]
        conformance = dict(zip(PRESENTATION, ("transitional", "strict"), strict=True)).get(root.namespace if root else "", "unknown")
        self.info = {"width": w / 12700, "height": h / 12700, "theme_colors": accents, "used_fonts": list(dict.fromkeys(f for f in fonts if f)), "conformance": conformance, "part_count": len(p.names)}
        self.scheme = scheme
        for n, (_, part) in enumerate(slides, 1):
            self.slide(n, part, theme)
        if self.o.xml:
            for part, node in p._xml.items():
                self.xml_rows(part, node)

    def xml_rows(self, part: str, root: Node | None) -> None:
        numbers = count()

        def add(n: Node, parent: int | None, depth: int) -> None:
            own = next(numbers)
            self.add("xml_nodes", part=part, node_id=own, parent_id=parent, ord=n.order, depth=depth, tag=n.tag, attrs=n.attrs, text=n.text)
            for c in n.children:
                add(c, own, depth + 1)

        if root:
            add(root, None, 1)

    def _scheme_node(self, theme: str | None) -> Node | None:
        root = self.p.xml(theme, required=False) if theme else None
        return root.child("a:themeElements", "a:clrScheme") if root else None

    def theme_colors(self, theme: str | None) -> dict[str, str]:
        clr = self._scheme_node(theme)
        out = {}
        for c in clr.children if clr else []:
            v = c.get("a:srgbClr", "val") or c.get("a:sysClr", "lastClr")
            if v:
                out[c.tag[2:]] = v
        return out

    def slide(self, n: int, part: str, theme: str | None) -> None:
        root = self.p.xml(part)
        layout = self.by_type(part, "slideLayout")
        master = self.by_type(layout, "slideMaster") if layout else None
        theme = (self.by_type(master, "theme") if master else None) or theme
        notes = self.by_type(part, "notesSlide")
        roots = [self.p.xml(x) if x else None for x in (part, layout, master)]
        self.part, self.layout, self.master, self.slide_root, self.layout_root, self.master_root = part, layout, master, *roots
        self.theme_root = self.p.xml(theme, required=False) if theme else None
        self.scheme = self.theme_colors(theme)
        maps = [r.child("p:clrMapOvr", "a:overrideClrMapping") if r else None for r in roots[:2]] + [roots[2].child("p:clrMap") if roots[2] else None]
        self.color_map = next((m.attrs for m in maps if m is not None), {})
        self.indexes = [self.placeholders(r) for r in roots[1:]]
        kind, ms, direction, after = self.transition(roots)
        self.add("slides", slide_no=n, part=part, layout_part=layout, master_part=master, theme_part=theme, notes_part=notes, note_html=self.notes(notes), background=self.background(roots), transition_type=kind, transition_ms=ms, transition_direction=direction, auto_next_after=after, hidden=bool(root is not None and root.attrs.get("show") in ("0", "false")))
        if root is None:
            return
        self.n = n
        decor = []
        if roots[1] is not None:
            decor.append(("layout", layout, roots[1]))
        if roots[2] is not None and not (roots[1] is not None and roots[1].attrs.get("showMasterSp") == "0") and root.attrs.get("showMasterSp") != "0":
            decor.append(("master", master, roots[2]))
        for origin, owner, r in decor:
            tree = r.child("p:cSld", "p:spTree")
            for i, node in enumerate(tree.children if tree else []):
                if self.placeholder(node) is None:
                    self.element(node, origin, owner, (i,), f"slide-{n}-{origin}")
        tree = root.child("p:cSld", "p:spTree")
        i = 0
        for node in tree.children if tree else []:
            if self.element(node, "slide", part, (i,), f"slide-{n}"):
                i += 1

    def transition(self, roots: list[Node | None]) -> tuple:
        for r in roots:
            if r is None:
                continue
            for at in (r, *(a for c in r.all("mc:AlternateContent") for a in c.all("mc:Choice") + c.all("mc:Fallback"))):
                t = at.child("p:transition")
                if t is None:
                    continue
                effect = next((c for c in t.children if c.tag.startswith(("p:", "p14:")) or re.match(r"p\d+:", c.tag)), None)
                dur = next((v for k, v in t.attrs.items() if re.match(r"p\d+:dur$", k)), None) or (effect.attrs.get("dur") if effect is not None else None)
                ms = n if (n := whole(dur)) is not None and n >= 0 else SPEED_MS.get(t.attrs.get("spd", ""), 1000)
                return (effect.tag.rpartition(":")[2] if effect is not None else None), ms, (effect.attrs.get("dir") if effect is not None else None), whole(t.attrs.get("advTm"))
        return None, None, None, None

    def notes(self, part: str | None) -> str | None:
        root = self.p.xml(part, required=False) if part else None
        tree = root.child("p:cSld", "p:spTree") if root else None
        out: list[str] = []
        for sp in tree.all("p:sp") if tree else []:
            ph, body = self.placeholder(sp), sp.child("p:txBody")
            if ph is None or ph.attrs.get("type") != "body" or body is None:
                continue
            lists = Lists()
            for p in body.all("a:p"):
                ppr = p.child("a:pPr")
                align = {"r": "right", "ctr": "center", "just": "justify", "dist": "justify"}.get(ppr.attrs.get("algn", "") if ppr is not None else "", "left")
                kind, level = self.bullet(ppr)
                out.append((lists.enter(kind, level) if kind else lists.leave()) + f'<p style="text-align:{align};">{"".join(self._html(t) for _, t in self.content(p))}</p>')
            out.append(lists.leave())
        return "".join(out) if out else None

    @staticmethod
    def bullet(ppr: Node | None) -> tuple[str | None, int]:
        """The kind of list of a paragraph, and its level."""
        if ppr is None:
            return None, 0
        level = whole(ppr.attrs.get("lvl"))
        return "ul" if ppr.child("a:buChar") else "ol" if ppr.child("a:buAutoNum") else None, level if level is not None and 0 < level <= 8 else 0

    # Placeholders.

    @staticmethod
    def placeholder(node: Node) -> Node | None:
        for kind in ("p:nvSpPr", "p:nvPicPr", "p:nvGraphicFramePr", "p:nvCxnSpPr", "p:nvGrpSpPr"):
            if (at := node.child(kind, "p:nvPr", "p:ph")) is not None:
                return at
        return None

    def placeholders(self, root: Node | None) -> tuple[dict[str, Node], dict[str, Node]]:
        """By idx (the last counts) and by type (the first counts); direct shapes only."""
        by_idx: dict[str, Node] = {}
        by_type: dict[str, Node] = {}
        tree = root.child("p:cSld", "p:spTree") if root else None
        for sp in tree.all("p:sp") if tree else []:
            if (ph := self.placeholder(sp)) is not None:
                if "idx" in ph.attrs:
                    by_idx[ph.attrs["idx"]] = sp
                if "type" in ph.attrs:
                    by_type.setdefault(ph.attrs["type"], sp)
        return by_idx, by_type

    def levels(self, node: Node, owner: str) -> Levels:
        ph = self.placeholder(node)
        found: list[Node | None] = [None, None]
        if ph is not None:
            idx, kind = ph.attrs.get("idx"), ph.attrs.get("type")
            for i, (by_idx, by_type) in enumerate(self.indexes):
                if kind and idx:
                    found[i] = by_idx.get(idx) or by_type.get(kind)
                elif kind:
                    found[i] = by_type.get(kind)
                elif idx:
                    found[i] = by_idx.get(idx)
                if found[i] is None and kind == "ctrTitle":
                    found[i] = by_type.get("title")
        role = ph.attrs.get("type") if ph is not None else None
        if ph is not None and role is None:
            inherited = [self.placeholder(f) for f in found if f is not None]
            role = next((x.attrs["type"] for x in inherited if x is not None and "type" in x.attrs), "obj")
        return Levels(node, found[0], found[1], role, owner)

    # Geometry.

    def box(self, levels: list[Node], prop: str = "p:spPr") -> tuple[float, float, float, float, float, bool, bool]:
        out = []
        for tag, keys in (("a:off", ("x", "y")), ("a:ext", ("cx", "cy"))):
            at = next((x for n in levels if (x := n.child(prop, "a:xfrm", tag)) is not None or (x := n.child("p:xfrm", tag)) is not None), None)
            for k in keys:
                v = whole(at.attrs.get(k)) if at is not None else 0
                bad = v is None or abs(v) > ooxml.SAFE_INTEGER or tag == "a:ext" and v < 0
                out.append(math.nan if bad else ooxml.emu_to_points(v))
        xfrm = next((x for n in levels if (x := n.child(prop, "a:xfrm") or n.child("p:xfrm")) is not None), None)
        rot = whole(xfrm.attrs.get("rot")) if xfrm is not None else None
        flips = [xfrm is not None and xfrm.attrs.get(k) == "1" for k in ("flipH", "flipV")]
        return (*out, float(ooxml.degrees(rot or 0)), *flips)  # type: ignore[return-value]

    # Colours, fills, borders.

    def color(self, holder: Node | None, phclr: str | None = None) -> str | None:
        """The colour that an element's child names, after its transforms in order."""
        node = next((c for c in holder.children if c.tag in _COLORS), None) if holder is not None else None
        if node is None:
            return None
        base = color.resolved(node.tag[2:], node.attrs, self.scheme, self.color_map, phclr)
        if base is None:
            return None
        steps = [(c.tag[2:], v) for c in node.children if (v := ooxml.percentage(c.attrs.get("val"))) is not None]
        return color.transformed(base, steps)

    def fill(self, props: Node | None, phclr: str | None = None) -> tuple[str, str | None, list, dict] | None:
        """(type, colour, stops, details) of the fill among an element's children; ("none", ...) stops the search, None goes on."""
        for c in props.children if props is not None else []:
            if c.tag == "a:noFill":
                return "none", None, [], {}
            if c.tag == "a:solidFill":
                return "color", self.color(c, phclr), [], {}
            if c.tag == "a:gradFill":
                stops = [(max(0.0, min(100.0, (ooxml.percentage(g.attrs.get("pos")) or 0) * 100)), self.color(g, phclr)) for g in (c.child("a:gsLst").all("a:gs") if c.child("a:gsLst") else [])]
                path = c.get("a:path", "path")
                angle = whole(c.get("a:lin", "ang")) if c.child("a:lin") is not None else None
                return "gradient", None, sorted(stops, key=lambda s: s[0]), {"gradient_angle": float(ooxml.degrees(angle or 0)), "gradient_path": path if path in ("circle", "rect", "shape") else "line"}
            if c.tag == "a:pattFill":
                return "pattern", self.color(c.child("a:fgClr"), phclr) or "#000000", [], {"pattern": c.attrs.get("prst", ""), "pattern_back": self.color(c.child("a:bgClr"), phclr) or "#ffffff"}
            if c.tag == "a:blipFill":
                amount = ooxml.percentage(c.get("a:blip", "a:alphaModFix", "amt"))
                return "image", None, [], {"fill_media": c.get("a:blip", "r:embed"), "fill_opacity": 1.0 if amount is None else max(0.0, min(1.0, amount))}
            if c.tag == "a:grpFill":
                return "group", None, [], {}
        return None

    def shape_fill(self, lv: Levels, groups: tuple[Node, ...]) -> tuple[str | None, str | None, list, dict]:
        for n, owner in ((n, o) for n, o in ((lv.own, lv.owner), (lv.layout, self.layout), (lv.master, self.master)) if n is not None):
            got = self.fill(n.child("p:spPr"))
            if got and got[0] == "group":
                got = next((f for g in reversed(groups) if (f := self.fill(g.child("p:grpSpPr"))) and f[0] != "group"), ("none", None, [], {}))
            if got is None and (ref := n.child("p:style", "a:fillRef")) is not None and ref.attrs.get("idx") not in ("0", "1000", None):
                base = self.color(ref)
                lst = self.theme_root.child("a:themeElements", "a:fmtScheme", "a:fillStyleLst") if self.theme_root else None
                i = whole(ref.attrs["idx"]) or 0
                own = lst.children[i - 1] if lst and 0 < i <= len(lst.children) else None
                holder = Node("x", {})
                holder.children = [own] if own is not None else []
                got = self.fill(holder, base[1:7] if base else None) or (("color", base, [], {}) if base else None)
            if got:
                if (rid := got[3].get("fill_media")) is not None:  # the part that the owner's relationship names
                    r = self.related(owner).get(rid) if owner else None
                    got[3]["fill_media"] = r["target"] if r and not r["is_external"] else None
                return (None, None, [], {}) if got[0] == "none" else got
        return None, None, [], {}

    def border(self, lv: Levels) -> tuple[str | None, float | None, str | None, str | None]:
        """Colour, width in points, css type and dash array of the outline; nulls without one."""
        for n in lv.nodes():
            ln, ref = n.child("p:spPr", "a:ln"), n.child("p:style", "a:lnRef")
            base = self.color(ref) if ref is not None else None
            if ln is not None and ln.child("a:noFill") is not None:
                return None, None, None, None
            i = whole(ref.attrs.get("idx")) if ref is not None else None
            lst = self.theme_root.child("a:themeElements", "a:fmtScheme", "a:lnStyleLst") if self.theme_root and i else None
            theme_ln = lst.children[i - 1] if lst and i and 0 < i <= len(lst.children) else None
            if ln is None and not i:
                continue
            paint = next((f for x in (ln, theme_ln) if (f := self.fill(x, base[1:7] if base else None))), None)
            c = (paint[1] if paint else None) or base
            if c is None and ln is None:
                continue
            width = next((v for x in (ln, theme_ln) if x is not None and (v := whole(x.attrs.get("w"))) is not None), None)
            dash = next((d for x in (ln, theme_ln) if x is not None and (d := x.get("a:prstDash", "val"))), "solid")
            known = dash if dash in DASHES else "solid"
            return c or "#000000", (width or 0) / 12700, "solid" if known == "solid" else "dotted" if known in ("dot", "sysDot") else "dashed", DASHES[known]
        return None, None, None, None

    def shadow(self, lv: Levels) -> tuple[float | None, float | None, float | None, str | None]:
        s = next((x for n in lv.nodes() if (x := n.child("p:spPr", "a:effectLst", "a:outerShdw")) is not None), None)
        if s is None:
            return None, None, None, None
        h, v, blur, paint = self._offsets(s)
        return h, v, blur, paint or "#000000"

    def _offsets(self, node: Node) -> tuple[float, float, float, str | None]:
        """Offsets, blur and colour of a shadow."""
        read = lambda k: v if (v := whole(node.attrs.get(k))) is not None and v >= 0 else 0
        d, t = read("dist") / 12700, math.radians(read("dir") / 60000)
        return ooxml.to_fixed(d * math.cos(t)) + 0.0, ooxml.to_fixed(d * math.sin(t)) + 0.0, ooxml.to_fixed(read("blurRad") / 12700), self.color(node)

    def background(self, roots: list[Node | None]) -> str:
        for r in roots:
            bg = r.child("p:cSld", "p:bg") if r else None
            if bg is None:
                continue
            if (pr := bg.child("p:bgPr")) is not None:
                got = self.fill(pr)
                return (got[1] if got else None) or "#fff"
            if (ref := bg.child("p:bgRef")) is not None:
                base, i = self.color(ref), whole(ref.attrs.get("idx")) or 0
                lst = self.theme_root.child("a:themeElements", "a:fmtScheme", "a:bgFillStyleLst") if self.theme_root else None
                own = lst.children[i - 1001] if lst and 1000 < i <= 1000 + len(lst.children) else None
                holder = Node("x", {})
                holder.children = [own] if own is not None else []
                got = self.fill(holder, base[1:7] if base else None)
                return (got[1] if got else None) or base or "#fff"
            return "#fff"
        return "#fff"

    # Text.

    def style_chain(self, lv: Levels, level: int, table: bool = False) -> list[Node]:
        """Paragraph property nodes from the body down to the master's text styles, in order of precedence."""
        tag = f"a:lvl{level + 1}pPr"
        out = []
        for n in lv.nodes():
            body = n.child("p:txBody")
            if body is None:
                continue
            if (x := body.child("a:lstStyle", tag)) is not None:
                out.append(x)
            if n is not lv.own and (x := body.child("a:p", "a:pPr")) is not None:
                out.append(x)
        style = "p:titleStyle" if lv.role in TITLE_ROLES[:2] else "p:bodyStyle" if lv.role in ("body", "subTitle", "obj", "half", "pic", "tbl", "chart") else "p:otherStyle"
        if self.master_root and (x := self.master_root.child("p:txStyles", style, tag)) is not None:
            out.append(x)
        if table and (root := self.p.xml("ppt/presentation.xml", required=False)) and (x := root.child("p:defaultTextStyle", tag)) is not None:
            out.append(x)
        return out

    def face(self, typeface: str | None, role: str | None) -> str | None:
        fonts = self.theme_root.child("a:themeElements", "a:fontScheme") if self.theme_root else None
        if typeface and typeface.startswith("+"):
            kind = "a:majorFont" if typeface.startswith("+mj") else "a:minorFont"
            script = {"lt": "a:latin", "ea": "a:ea", "cs": "a:cs"}.get(typeface[4:], "a:latin")
            return (fonts.get(kind, script, "typeface") if fonts else None) or typeface[1:]
        return typeface or (fonts.get("a:majorFont" if role in TITLE_ROLES else "a:minorFont", "a:latin", "typeface") if fonts else None)

    def content(self, p: Node) -> list[tuple[Node | None, str]]:
        """Runs, fields and breaks in order: (node, text)."""
        out = []
        for c in p.children:
            if c.tag in ("a:r", "a:fld"):
                t = c.child("a:t")
                out.append((c, ooxml.decode_office((t.text or "") if t else "")))
            elif c.tag == "a:br":
                out.append((c, "\n"))
            elif c.tag in ("a14:m", "mc:AlternateContent") and (m := next((x for x in c.walk() if x.tag == "m:oMath"), None)):
                out.append((c, latex(m)))
        return out

    def plain(self, body: Node) -> str:
        """The plain text of a body, as text() has it."""
        return "\n".join(["".join([t for _, t in self.content(p)]) for p in body.children if p.tag == "a:p"])

    @staticmethod
    def _html(text: str) -> str:
        return "<br>" if text == "\n" else re.sub(r"\s", lambda m: "&nbsp;" * 4 if m[0] == "\t" else "&nbsp;", ooxml.escape_html(text))

    def text(self, lv: Levels, body: Node, key: str, cell: tuple[int | None, int | None] = (None, None), table: bool = False) -> tuple[str, str]:
        """Adds the runs of a body; returns its HTML and its plain text."""
        html, plain, lists = [], [], Lists()
        for pi, p in enumerate(body.all("a:p")):
            ppr = p.child("a:pPr")
            kind, level = self.bullet(ppr)
            chain = ([ppr] if ppr is not None else []) + self.style_chain(lv, level, table)
            first = lambda get, chain=chain: next((v for n in chain if (v := get(n)) is not None), None)
            align = {"l": "left", "ctr": "center", "r": "right", "just": "justify", "dist": "justify", "justLow": "justify", "thaiDist": "justify"}.get(first(lambda n: n.attrs.get("algn")) or "l", "left")
            space: dict = {}
            for name, css, tag in (("line_height", "line", "a:lnSpc"), ("space_before", "before", "a:spcBef"), ("space_after", "after", "a:spcAft")):
                pct, pts = first(lambda n, tag=tag: _spacing(n.child(tag))) or (None, None)
                space[name] = pct if pct is not None else pts
                space[css] = None if pct is None and pts is None else f"{ooxml.js_number(pts)}pt" if pct is None else ooxml.js_number(pct) + ("" if css == "line" else "em")
            marl, indent = (whole(first(lambda n, k=k: n.attrs.get(k))) for k in ("marL", "indent"))
            parts = self.content(p)
            spans: list[tuple[tuple, str, str | None]] = []
            for ri, (node, t) in enumerate(parts):
                st, link = self.run_style(lv, p, node, chain)
                self.add("runs", slide_no=self.n, key=key, row_no=cell[0], col_no=cell[1], para_no=pi, run_no=ri, kind={"a:r": "run", "a:fld": "field", "a:br": "break"}.get(node.tag, "math"), text=t, link=link, align=align, list_type=kind, list_level=level, **{k: v for k, v in st.items() if k != "gradient"}, **{k: space[k] for k in ("line_height", "space_before", "space_after")}, indent=indent / 12700 if indent is not None else None, margin_left=marl / 12700 if marl is not None else None)
                style = tuple(st.items())
                shown = "\xa0" if node.tag in ("a:r", "a:fld") and node.child("a:t") is None else t
                if spans and link is None and spans[-1][2] is None and spans[-1][0] == style and t != "\n" and spans[-1][1] != "\n":
                    spans[-1] = (style, spans[-1][1] + shown, None)
                else:
                    spans.append((style, shown, link))
            if not parts:
                st, _ = self.run_style(lv, p, p, chain)
                spans.append((tuple(st.items()), "\xa0", None))
            inner = "".join("<br>" if t == "\n" else self.span(dict(style), t, link) for style, t, link in spans)
            css = f"text-align: {align};" + "".join(f"{k}: {space[n]};" for k, n in (("line-height", "line"), ("margin-top", "before"), ("margin-bottom", "after")) if space[n] is not None)
            if not kind:
                css += "".join(f"{k}: {ooxml.js_number(ooxml.emu_to_points(v))}pt;" for k, v in (("margin-left", marl), ("text-indent", indent)) if v is not None)
            html.append((lists.enter(kind, level) if kind else lists.leave()) + f'<p style="{ooxml.escape_html(css)}">{inner}</p>')
            plain.append("".join(t for _, t in parts))
        return "".join(html) + lists.leave(), "\n".join(plain)

    def run_style(self, lv: Levels, p: Node, node: Node, chain: list[Node]) -> tuple[dict, str | None]:
        rpr = node.child("a:rPr") if node.child("a:rPr") is not None else p.child("a:endParaRPr")
        props = ([rpr] if rpr is not None else []) + [d for n in chain if (d := n.child("a:defRPr")) is not None]
        first = lambda get: next((v for n in props if (v := get(n)) is not None), None)
        size = whole(first(lambda n: n.attrs.get("sz")))
        typeface = next((v for tag in ("a:latin", "a:ea", "a:cs", "a:sym") if (v := first(lambda n, tag=tag: n.get(tag, "typeface")))), None)
        ref = next((x for n in lv.nodes() if (x := n.child("p:style", "a:fontRef")) is not None), None)
        paint = next((f[1] for n in props[: len(props)] if (f := self.fill(n)) and f[0] == "color" and f[1]), None) or (self.color(ref) if ref is not None else None)
        base = whole(first(lambda n: n.attrs.get("baseline")))
        spacing = whole(first(lambda n: n.attrs.get("spc")))
        grad = next((f for n in props if (f := self.fill(n)) and f[0] in ("color", "gradient")), None)
        shade = first(lambda n: n.child("a:effectLst", "a:outerShdw"))
        link = None
        if rpr is not None and (h := rpr.child("a:hlinkClick")) is not None:
            r = self.related(self.part).get(h.attrs.get("r:id", ""))
            link = ooxml.sanitize_link(r["target"]) if r and r["type"] == "hyperlink" else None
        st = {
            "face": self.face(typeface, lv.role), "size": size / 100 if size else 12.0 if lv.role in SMALL_ROLES else 18.0, "color": paint, "bold": first(lambda n: n.attrs.get("b")) in ("1", "true"), "italic": first(lambda n: n.attrs.get("i")) in ("1", "true"),
            "underline": first(lambda n: n.attrs.get("u")) not in (None, "none"), "strike": first(lambda n: n.attrs.get("strike")) not in (None, "noStrike"), "baseline": "super" if (base or 0) > 0 else "sub" if (base or 0) < 0 else None,
            "spacing": spacing / 100 if spacing else None, "shadow": self.css_shadow(shade), "gradient": (grad[3]["gradient_angle"], tuple(grad[2])) if grad and grad[0] == "gradient" else None,
        }
        return st, link

    def css_shadow(self, node: Node | None) -> str | None:
        if node is None:
            return None
        h, v, blur, paint = self._offsets(node)
        return " ".join([f"{ooxml.js_number(h)}pt", f"{ooxml.js_number(v)}pt", *([f"{ooxml.js_number(blur)}pt"] if blur else []), *([paint] if paint else [])])

    def span(self, st: dict, text: str, link: str | None) -> str:
        if st["gradient"]:
            angle, stops = st["gradient"]
            colors = ", ".join(f"{c} {ooxml.js_number(pos)}%" for pos, c in stops)
            css = [f"background: linear-gradient({ooxml.js_number(angle + 90)}deg, {colors});", " background-clip: text;", " color: transparent;"]
        else:
            css = [f"color: {st['color']};"] if st["color"] else []
        css += [f"font-size: {ooxml.js_number(st['size'])}pt;"]
        css += [f"font-family: {ooxml.css_family(st['face'])};"] if st["face"] else []
        for name, value in (("font-weight", "bold" if st["bold"] else None), ("font-style", "italic" if st["italic"] else None), ("text-decoration", "underline" if st["underline"] else None), ("text-decoration-line", "line-through" if st["strike"] else None),
                            ("letter-spacing", f"{ooxml.js_number(st['spacing'])}pt" if st["spacing"] else None), ("vertical-align", st["baseline"]), ("text-shadow", st["shadow"])):
            css += [f"{name}: {value};"] if value else []
        t = self._html(text)
        if link:
            t = f'<a href="{ooxml.escape_html(link)}" target="_blank" rel="noopener noreferrer">{t}</a>'
        return f'<span style="{ooxml.escape_html("".join(css))}">{t}</span>'

    # Elements.

    def element(self, node: Node, origin: str, owner: str, path: tuple[int, ...], prefix: str, groups: tuple[Node, ...] = (), place: tuple[float, float, float, float] = (0, 0, 1, 1)) -> bool:
        """Adds an element and what it holds; False for nodes that are none. place: offset and scale into the parent's space."""
        kinds = {"p:sp": self.shape, "p:cxnSp": self.shape, "p:pic": self.picture, "p:graphicFrame": self.frame, "p:grpSp": self.group}
        if node.tag == "mc:AlternateContent":
            math_node = next((x for x in node.walk() if x.tag == "m:oMath"), None)
            inner = node.child("mc:Fallback") or node.child("mc:Choice")
            for c in inner.children if inner else []:
                if c.tag == "p:grpSp" or math_node is None and c.tag in kinds:
                    return self.element(c, origin, owner, path, prefix, groups, place)
                if math_node is not None and c.tag in kinds:
                    row = self.base(c, self.levels(c, owner), origin, path, prefix, place)
                    self.add("elements", **row, type="math", latex=latex(math_node), content="", plain_text="")
                    return True
            return False
        if node.tag not in kinds:
            return False
        return kinds[node.tag](node, origin, owner, path, prefix, groups, place)

    def base(self, node: Node, lv: Levels, origin: str, path: tuple[int, ...], prefix: str, place: tuple, prop: str = "p:spPr") -> dict:
        left, top, width, height, rot, fh, fv = self.box(lv.nodes(), prop)
        dx, dy, sx, sy = place
        if place != (0, 0, 1, 1):
            # Scaled about its centre; a quarter turn swaps the axes.
            cx, cy = dx + (left + width / 2) * sx, dy + (top + height / 2) * sy
            width, height = (width * sy, height * sx) if rot % 360 in (90, 270) else (width * sx, height * sy)
            left, top, width, height = (ooxml.to_fixed(v) for v in (cx - width / 2, cy - height / 2, width, height))
        nv = next((x for c in node.children if c.tag.startswith("p:nv") and (x := c.child("p:cNvPr")) is not None), None)
        link = None
        if nv is not None and (h := nv.child("a:hlinkClick")) is not None:
            r = self.related(self.part).get(h.attrs.get("r:id", ""))
            link = ooxml.sanitize_link(r["target"]) if r and r["type"] == "hyperlink" else None
        key = f"{prefix}-element-" + "-element-".join(str(i + 1) for i in path)
        return {"slide_no": self.n, "origin": origin, "tree_path": list(path), "key": key, "id": nv.attrs.get("id") if nv is not None else None, "name": nv.attrs.get("name") if nv is not None else None, "ord": node.order, "left": left, "top": top, "width": width, "height": height, "rotate": rot, "flip_h": fh, "flip_v": fv, "link": link}

    def shape(self, node: Node, origin: str, owner: str, path: tuple, prefix: str, groups: tuple, place: tuple) -> bool:
        lv = self.levels(node, owner)
        row = self.base(node, lv, origin, path, prefix, place)
        kind, paint, stops, more = self.shape_fill(lv, groups)
        bc, bw, bt, bd = self.border(lv)
        sh, sv, sb, sc = self.shadow(lv)
        body = node.child("p:txBody")
        html, plain = self.text(lv, body, row["key"]) if body is not None else ("", "")
        geometry = next((g for n in lv.nodes() if (g := n.child("p:spPr", "a:prstGeom") or n.child("p:spPr", "a:custGeom")) is not None), None)
        custom = geometry is not None and geometry.tag == "a:custGeom"
        preset = geometry.attrs.get("prst", "rect") if geometry is not None and not custom else "rect"
        box = node.get("p:nvSpPr", "p:cNvSpPr", "txBox") == "1"
        role = lv.role or ("text" if box else None)
        is_text = not custom and preset == "rect" and role is not None and role != "obj" and (bool(plain.strip()) or kind is None and bc is None)
        is_shape = geometry is not None and not is_text or node.tag == "p:cxnSp"
        guides = {}
        for g in geometry.child("a:avLst").all("a:gd") if geometry is not None and not custom and geometry.child("a:avLst") else []:
            f = g.attrs.get("fmla", "").split()
            if len(f) == 2 and f[0] == "val" and _INT.match(f[1]):
                guides[g.attrs.get("name", "")] = float(f[1])
        svg, exact, only = None, True, None
        w, h = row["width"], row["height"]
        if is_shape:
            if custom:
                svg, only = custom_path(geometry, w, h)
                preset = classify(geometry)
            else:
                svg, exact = preset_path(preset, w, h, guides)
                only = preset in STROKE_ONLY
        bp = [b for n in lv.nodes() if (b := n.child("p:txBody", "a:bodyPr")) is not None]
        inset = {f"inset_{k}": ((next((v for b in bp if (v := whole(b.attrs.get(f"{k}Ins"))) is not None), d)) / 12700 if bp else None) for k, d in INSETS.items()}
        fit = next((c for b in bp for c in b.children if c.tag in ("a:noAutofit", "a:spAutoFit", "a:normAutofit")), None)
        scale = ooxml.percentage(fit.attrs.get("fontScale")) if fit is not None else None
        anchor = next((v for b in bp if (v := b.attrs.get("anchor"))), None)
        line = next((x for n in lv.nodes() if (x := n.child("p:spPr", "a:ln")) is not None), None)
        ends = {f"{k}_end": t if line is not None and (t := line.get(f"a:{k}End", "type")) not in (None, "none") else None for k in ("head", "tail")}
        self.add(
            "elements", **row, **inset, **ends, **more, type="shape" if is_shape else "text", fill_type=kind, fill_color=paint, border_color=bc, border_width=bw, border_type=bt, border_dash=bd, shadow_h=sh, shadow_v=sv, shadow_blur=sb, shadow_color=sc, content=html, plain_text=plain,
            v_align={"ctr": "mid", "b": "down"}.get(anchor or "", "up"), auto_fit={"a:spAutoFit": "shape", "a:normAutofit": "text"}.get(fit.tag) if fit is not None else None, font_scale=scale * 100 if scale is not None and 0.01 <= scale <= 1 else None,
            is_vertical=next((b.attrs["vert"] for b in bp if "vert" in b.attrs), "horz") in ("eaVert", "vert", "vert270", "wordArtVert", "mongolianVert"), shape_type=preset if is_shape else None, svg_path=svg, stroke_only=only, keypoints={k: v / 50000 for k, v in guides.items()} or None,
        )
        for i, (pos, c) in enumerate(stops):
            self.add("gradient_stops", slide_no=self.n, key=row["key"], stop_no=i, pos=pos, color=c)
        return True

    def picture(self, node: Node, origin: str, owner: str, path: tuple, prefix: str, groups: tuple, place: tuple) -> bool:
        lv = self.levels(node, owner)
        row = self.base(node, lv, origin, path, prefix, place)
        rels = self.related(owner)
        kind, ref = "image", node.get("p:blipFill", "a:blip", "r:embed")
        for media in ("video", "audio"):
            at = node.child("p:nvPicPr", "p:nvPr", f"a:{media}File")
            if at is not None:
                kind, ref = media, at.attrs.get("r:link")
                break
        r = rels.get(ref or "")
        if r is None:
            return False
        target = r["target"]
        if r["is_external"]:
            target = target if kind == "video" and re.match(r"(https?|ftp):", target, re.IGNORECASE) else None
        crop = node.child("p:blipFill", "a:srcRect")
        crops = {f"crop_{k}": int(crop.attrs[k]) / 1000 if crop is not None and _INT.match(crop.attrs.get(k, "")) else None for k in "tblr"}
        geometry, custom = node.child("p:spPr", "a:prstGeom"), node.child("p:spPr", "a:custGeom")
        name = geometry.attrs.get("prst") if geometry is not None else f"custom:{classify(custom)}" if custom is not None else None
        mode = None if target is None else "link" if r["is_external"] else "data" if kind == "image" or ooxml.extension(target) in PLAYABLE[kind] else "ref"
        self.add("elements", **row, **crops, **self.picture_filters(node.child("p:blipFill", "a:blip")), type=kind, media_part=target, media_mode=mode, shape_type=name, content="", plain_text="")
        return True

    @staticmethod
    def picture_filters(blip: Node | None) -> dict:
        """Ratios of the picture's effects (later ones win) and its opacity. A negative sharpness softens."""
        out: dict = {}
        for x in blip.walk() if blip is not None else ():
            name = x.tag.rpartition(":")[2]
            val = lambda k, x=x: ooxml.percentage(x.attrs.get(k))
            if name == "saturation":
                out["saturation"] = val("sat")
            elif name == "brightnessContrast":
                out |= {k: val(a) for k, a in (("brightness", "bright"), ("contrast", "contrast")) if val(a) is not None}
            elif name == "sharpenSoften" and (v := val("amount")):
                out["sharpen" if v > 0 else "soften"] = abs(v)
            elif name == "colorTemperature":
                out["color_temperature"] = float(n) if (n := whole(x.attrs.get("colorTemp"))) is not None and n >= 0 else None
            elif name == "alphaModFix":
                out["opacity"] = val("amt")
        return out

    def group(self, node: Node, origin: str, owner: str, path: tuple, prefix: str, groups: tuple, place: tuple) -> bool:
        lv = Levels(node, None, None, None, owner)
        row = self.base(node, lv, origin, path, prefix, place, "p:grpSpPr")
        self.add("elements", **row, type="group", content="", plain_text="")
        x = node.child("p:grpSpPr", "a:xfrm")
        get = lambda tag, k: ooxml.emu_to_points(v) if x is not None and (v := whole(x.get(tag, k))) is not None else 0.0
        cw, ch = get("a:chExt", "cx"), get("a:chExt", "cy")
        ow, oh = get("a:ext", "cx"), get("a:ext", "cy")
        sx, sy = (ow / cw if cw else 1.0) * place[2], (oh / ch if ch else 1.0) * place[3]
        inner = (row["left"] - get("a:chOff", "x") * sx, row["top"] - get("a:chOff", "y") * sy, sx, sy)
        i = 0
        for c in node.children:
            if self.element(c, origin, owner, (*path, i), prefix, (*groups, node), inner):
                i += 1
        return True

    def frame(self, node: Node, origin: str, owner: str, path: tuple, prefix: str, groups: tuple, place: tuple) -> bool:
        data = node.child("a:graphic", "a:graphicData")
        uri = data.attrs.get("uri", "") if data is not None else ""
        lv = self.levels(node, owner)
        row = self.base(node, lv, origin, path, prefix, place)
        if uri.endswith("/table") and (tbl := data.child("a:tbl")) is not None:
            self.table(row, lv, tbl)
        elif uri.endswith("/chart"):
            self.chart(row, owner, data.get("c:chart", "r:id"))
        elif uri.endswith("/diagram"):
            self.diagram(row, owner, data.child("dgm:relIds"), place)
        elif uri.endswith("/ole"):
            pic = next((x for x in data.walk() if x.tag == "p:pic"), None)
            return self.element(pic, origin, owner, path, prefix, groups, place) if pic is not None else False
        else:
            return False
        return True

    def table(self, row: dict, lv: Levels, tbl: Node) -> None:
        grid = [(whole(c.attrs.get("w")) or 0) / 12700 for c in (tbl.child("a:tblGrid").all("a:gridCol") if tbl.child("a:tblGrid") else [])]
        if total := sum(grid):
            row["width"] = ooxml.to_fixed(total)
        flags = tbl.child("a:tblPr").attrs if tbl.child("a:tblPr") is not None else {}
        on = {k: boolean(flags.get(k)) for k in ("firstRow", "lastRow", "firstCol", "lastCol", "bandRow", "bandCol")}
        style = self.table_style(tbl)
        rows = tbl.all("a:tr")
        quiet = not self.keeps("runs")  # then a cell's text is all that is wanted of its body
        if not self.keeps("table_cells") and quiet:
            rows = []
        kept = self.rows.setdefault("table_cells", []) if rows and self.keeps("table_cells") else []
        alike: dict[Shape, tuple[bool, dict] | None] | None = {} if quiet and not style else None
        for i, tr in enumerate(rows):
            cells = tr.all("a:tc")
            height = (whole(tr.attrs.get("h")) or 0) / 12700
            for j, tc in enumerate(cells):
                if alike is not None and tc.__class__ is Cell and (like := alike.get(tc.shape) or self.alike(tc, alike)):
                    said, out = like
                    kept.append({**out, "slide_no": self.n, "key": row["key"], "row_no": i, "col_no": j, "text": ooxml.decode_office(tc.value) if said else "", "width": grid[j] if j < len(grid) else None, "height": height})
                    continue
                out = self.cell_look(tc)
                body = tc.child("a:txBody")
                plain = "" if body is None else self.plain(body) if quiet else self.text(lv, body, row["key"], (i, j), True)[1]
                if style:
                    look = self.region(style, on, i, len(rows), j, len(cells))
                    own = out["fill_color"] if self.fill(tc.child("a:tcPr")) else look.get("fill")
                    out |= {"fill_color": own, "font_color": look.get("color"), "font_bold": look.get("bold")}
                self.add("table_cells", slide_no=self.n, key=row["key"], row_no=i, col_no=j, text=plain, width=grid[j] if j < len(grid) else None, height=height, **out)
        self.add("elements", **row, type="table", content="", plain_text="")

    def cell_look(self, tc: Node) -> dict:
        """A cell's spans, own fill, place of the text and borders."""
        pr = tc.child("a:tcPr")
        num = lambda k: n if (n := whole(tc.attrs.get(k))) is not None and n > 1 else None
        own = self.fill(pr)
        borders = {f"border_{side}": self.color(x.child("a:solidFill")) if pr is not None and (x := pr.child(f"a:ln{tag}")) is not None else None for side, tag in (("top", "T"), ("bottom", "B"), ("left", "L"), ("right", "R"))}
        return {"row_span": num("rowSpan"), "col_span": num("gridSpan"), "v_merge": tc.attrs.get("vMerge") == "1", "h_merge": tc.attrs.get("hMerge") == "1", "fill_color": own[1] if own else None, "font_color": None, "font_bold": None, "v_align": {"ctr": "mid", "b": "down"}.get(pr.attrs.get("anchor", "") if pr is not None else "", "up"), **borders}

    def alike(self, tc: Cell, known: dict[Shape, tuple[bool, dict] | None]) -> tuple[bool, dict] | None:
        """Whether the plain text of cells of a shape is their one text, or nothing, and their looks; None if it is neither."""
        if tc.shape not in known:
            body = Cell(tc.shape, sample := "\ue000", tc.shape.count).child("a:txBody")
            plain = "" if body is None else self.plain(body)
            known[tc.shape] = (plain == sample, self.cell_look(tc)) if tc.shape.plain and plain in (sample, "") else None
        return known[tc.shape]

    def table_style(self, tbl: Node) -> dict[str, dict]:
        """Parts of the table's style: fill, text colour and weight by region."""
        node = tbl.child("a:tblPr", "a:tableStyleId")
        root = self.p.xml("ppt/tableStyles.xml", required=False) if node is not None else None
        style = next((s for s in root.all("a:tblStyle") if s.attrs.get("styleId") == (node.text or "")), None) if root else None
        out = {}
        for part in style.children if style else []:
            tx = part.child("a:tcTxStyle")
            got = self.fill(part.child("a:tcStyle", "a:fill"))
            out[part.tag[2:]] = {"fill": got[1] if got else None, "color": self.color(tx) if tx is not None else None, "bold": boolean(tx.attrs.get("b")) if tx is not None else None}
        return out

    @staticmethod
    def region(style: dict[str, dict], on: dict, i: int, n: int, j: int, m: int) -> dict:
        """Looks of a cell: whole table, row band (never row 0), first and last row; then one column region."""
        layers = ["wholeTbl"]
        if on["bandRow"] and i > 0:
            layers.append("band2H" if i % 2 == 0 else "band1H")
        if on["firstRow"] and i == 0:
            layers.append("firstRow")
        if on["lastRow"] and i == n - 1:
            layers.append("lastRow")
        column = None
        if on["firstCol"] and j == 0:
            column = "firstCol"
        elif on["lastCol"] and j == m - 1:
            column = "lastCol"
        elif on["bandCol"]:
            column = "band1V" if (j - (1 if on["firstCol"] else 0)) % 2 == 0 else "band2V"
        if column in ("firstCol", "lastCol"):
            corner = {("firstRow", "firstCol"): "nwCell", ("firstRow", "lastCol"): "neCell", ("lastRow", "firstCol"): "swCell", ("lastRow", "lastCol"): "seCell"}
            edge = "firstRow" if on["firstRow"] and i == 0 else "lastRow" if on["lastRow"] and i == n - 1 else None
            if edge and corner[edge, column] in style:
                column = corner[edge, column]
        out: dict = {}
        for layer in [*layers, *([column] if column else [])]:
            out |= {k: v for k, v in style.get(layer, {}).items() if v}
        return out

    def chart(self, row: dict, owner: str, rid: str | None) -> None:
        r = self.related(owner).get(rid or "")
        root = self.p.xml(r["target"]) if r and not r["is_external"] else None
        plot = root.child("c:chart", "c:plotArea") if root else None
        node = next((c for c in plot.children if c.tag.startswith("c:") and c.tag[2:].removesuffix("Chart") in CHART_KINDS and c.tag.endswith("Chart") and c.all("c:ser")), None) if plot else None
        if node is None:
            return
        kind = node.tag[2:].removesuffix("Chart")
        series = node.all("c:ser")

        def cached(holder: Node | None) -> list[tuple[int, str]]:
            ref = next((c for c in holder.children if c.tag in ("c:strRef", "c:numRef")), None) if holder is not None else None
            cache = next((c for c in ref.children if c.tag in ("c:strCache", "c:numCache")), None) if ref is not None else holder.child("c:numLit") or holder.child("c:strLit") if holder is not None else None
            return [(whole(p.attrs.get("idx")) or 0, (p.child("c:v").text or "") if p.child("c:v") else "") for p in (cache.all("c:pt") if cache is not None else [])]

        if kind in ("scatter", "bubble"):
            for n, values in enumerate([cached(series[0].child("c:xVal")), *(cached(s.child("c:yVal")) for s in series)]):
                for i, v in values:
                    self.add("chart_xy", slide_no=self.n, key=row["key"], row_no=n, idx=i, v=number(v) or 0.0)
        else:
            for n, s in enumerate(series):
                name = cached(s.child("c:tx"))
                labels = dict(cached(s.child("c:cat")))
                paint = None if kind == "stock" else (self.fill(s.child("c:spPr")) or (None, None))[1]
                slices = {whole(d.get("c:idx", "val")): (self.fill(d.child("c:spPr")) or (None, None))[1] for d in s.all("c:dPt")} if kind in ("pie", "pie3D", "doughnut") else {}
                for i, v in cached(s.child("c:val")):
                    self.add("chart_points", slide_no=self.n, key=row["key"], series_no=n, series_name=name[0][1] if name else str(n), series_color=slices.get(i, paint), idx=i, category=labels.get(i), y=number(v) or 0.0)
        hole = node.get("c:holeSize", "val")
        self.add("elements", **row, type="chart", chart_type=f"{kind}Chart", bar_dir=node.get("c:barDir", "val"), grouping=node.get("c:grouping", "val"), hole_size=number(hole), marker=node.child("c:marker") is not None if kind == "line" else None, content="", plain_text="")

    def diagram(self, row: dict, owner: str, ids: Node | None, place: tuple) -> None:
        rels = self.related(owner)
        data_rel = rels.get(ids.attrs.get("r:dm", "") if ids is not None else "")
        data = self.p.xml(data_rel["target"]) if data_rel else None
        texts = []
        for pt in data.child("dgm:ptLst").all("dgm:pt") if data and data.child("dgm:ptLst") else []:
            t = pt.child("dgm:t")
            line = "".join((x.text or "") for x in t.walk() if x.tag == "a:t") if t else ""
            if line:
                texts.append(line)
        for i, t in enumerate(texts):
            self.add("diagram_text", slide_no=self.n, key=row["key"], n=i, text=t)
        self.add("elements", **row, type="diagram", content="", plain_text="\n".join(texts))
        ext = next((x for x in data.walk() if x.tag.endswith(":dataModelExt")), None) if data else None
        rid = ext.attrs.get("relId", "") if ext is not None else ""
        drawing = (self.related(data_rel["target"]).get(rid) if data_rel else None) or rels.get(rid)
        root = self.p.xml(drawing["target"]) if drawing else None
        tree = root.child("dsp:spTree") if root else None
        inner = (row["left"], row["top"], place[2], place[3])
        i = 0
        for sp in tree.all("dsp:sp") if tree else []:
            for x in sp.walk():
                if x.tag.startswith("dsp:"):
                    x.tag = "p:" + x.tag[4:]
            if self.element(sp, "diagram", drawing["target"], (*row["tree_path"], i), f"slide-{self.n}", (), inner):
                i += 1


def parse_deck(raw: bytes, path: str = "", options: Options | None = None) -> dict:
    """The row of a deck (see schema.deck_row). Failures are rows too: status `failed` with code and message."""
    options = options or Options()
    row: dict = {"deck_id": hashlib.sha256(raw).hexdigest(), "path": path, "byte_length": len(raw), "status": "ok", "code": None, "message": None}
    deck, collects = None, gc.isenabled()
    gc.disable()  # trees have no cycles, and looking for some takes a third of the time
    try:
        deck = Deck(open_package(raw, options.limits, options.strict), options)
        deck.parse()
    except PackageError as e:
        return row | {"status": "failed", "code": e.code, "message": str(e)}
    except Exception as e:  # no content of one package may stop the others
        return row | {"status": "failed", "code": "invalid-content", "message": f"{type(e).__name__}: {e}"}
    finally:
        if collects:
            gc.enable()
    return row | deck.info | deck.rows | {"diagnostics": deck.p.diagnostics}


def parse_decks(rows: Iterator[tuple[str, bytes]], options: Options) -> Iterator[dict]:
    for path, raw in rows:
        yield parse_deck(bytes(raw), path, options)
