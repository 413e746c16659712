"""Scene validation: closed keys, numbers, keys and references, tables and their merges, charts, media signatures, totals.

`validate_scene` judges one scene in memory. The table functions judge scenes that are already rows, with aggregates and anti-joins.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.functions.ooxml import EMU_PER_POINT, hex_color, js_round, utf16_length, units, xml_safe

# Limits of creation.
LIMITS = {"elements": 5000, "slides": 10_000, "chart_points": 100_000, "media": 1000, "media_bytes": 64 << 20, "all_media_bytes": 256 << 20, "paragraphs": 10_000, "text_nodes": 40_000, "code_units": 8 << 20}
SERIES, SERIES_POINTS = 64, 10_000
WRITABLE_CHARTS = ("bar", "doughnut", "line", "pie")
KEY = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
SCENE_KEYS = {"schemaVersion", "size", "themes", "masters", "layouts", "media", "slides"}
ELEMENT_TYPES = ("text", "shape", "image", "table", "chart", "group", "unsupported")
PROFILES = ("scene", "create-native", "create-text")
BASE_KEYS = set("authored description fillColor geometry hidden key lineColor lineWidth name placeholder resolved title transform type".split())
OWN_KEYS = {
    "text": {"body", "paragraphs"}, "shape": {"body", "paragraphs"}, "image": {"crop", "mediaKey"}, "group": {"childSpace", "elements"}, "unsupported": {"feature", "previewText"},
    "chart": {"barDirection", "chartType", "grouping", "holeSize", "marker", "series"}, "table": {"bandCol", "bandRow", "columns", "firstCol", "firstRow", "lastCol", "lastRow", "rows"},
}
AUTHORED_KEYS = {"fillColor", "geometry", "hidden", "lineColor", "lineWidth", "transform"}
TRANSFORM_KEYS = {"flipHorizontal", "flipVertical", "height", "rotation", "width", "x", "y"}
RUN_KEYS = {"bold", "color", "fontFamily", "fontSize", "italic", "language", "strike", "underline"}
NODE_KEYS = {"run": {"key", "preserveSpace", "properties", "text", "type"}, "field": {"fieldType", "id", "key", "properties", "text", "type"}, "break": {"key", "properties", "type"}}
PARAGRAPH_KEYS = {"align", "children", "endProperties", "key", "level"}
CELL_KEYS = {"borders", "colSpan", "fillColor", "hMerge", "key", "paragraphs", "rowSpan", "text", "vMerge"}
PLACEHOLDER_KEYS = {"hasCustomPrompt", "index", "orientation", "prompt", "role", "size", "sourceKey", "type"}
CHOICES = {
    "anchor": ("bottom", "middle", "top"), "autoFit": ("none", "shape", "text"), "align": ("center", "justify", "left", "right"), "role": ("layout-definition", "master-definition", "slide-instance"), "orientation": ("horizontal", "vertical"), "size": ("full", "half", "quarter"),
    "barDirection": ("bar", "col"), "grouping": ("clustered", "percentStacked", "stacked", "standard"),
}
# End of fixed values.


def signature(data: bytes) -> str | None:
    """image/png or image/jpeg by the first bytes."""
    return "image/png" if data[:8] == b"\x89PNG\r\n\x1a\n" else "image/jpeg" if data[:3] == b"\xff\xd8\xff" else None


def validate_scene(scene: dict, profile: str = "create-native") -> list[dict]:
    """Issues {code, message, path} in order; none: the scene can be written.

    Profile `scene` judges a document of any kind; the others what can be written: packages get a minimal hierarchy of their own, so themes, masters, layouts, placeholders and opaque elements are refused, and `create-text` takes text boxes only.
    """
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    creates = profile != "scene"
    out: list[dict] = []
    keys: set[str] = set()
    totals = dict.fromkeys(LIMITS, 0)
    issue = lambda code, path, message: out.append({"code": code, "message": message, "path": path})

    def closed(x: dict, allowed: set[str], path: str) -> None:
        for k in x:
            if k not in allowed:
                issue("unknown-key", f"{path}.{k}", f"{k} is not a property here")

    def choice(x: dict, name: str, path: str, required: bool = False) -> None:
        v = x.get(name)
        if (required or v is not None) and v not in CHOICES[name]:
            issue("invalid-value", f"{path}.{name}", f"not one of {', '.join(CHOICES[name])}")

    def flags(x: dict, names: tuple[str, ...], path: str) -> None:
        for k in names:
            if x.get(k) is not None and not isinstance(x[k], bool):
                issue("invalid-value", f"{path}.{k}", "neither true nor false")

    def strings(x: dict, names: tuple[str, ...], path: str) -> None:
        for k in names:
            if x.get(k) is not None and not (isinstance(x[k], str) and xml_safe(x[k])):
                issue("invalid-text", f"{path}.{k}", "not text that XML can hold")

    def a_dict(x: object, path: str) -> bool:
        if isinstance(x, dict):
            return True
        issue("invalid-value", path, "not an object")
        return False

    def key(x: dict, path: str) -> None:
        k = x.get("key")
        if k is None:
            return
        if not isinstance(k, str) or not re.match(KEY, k):
            issue("invalid-key", path, "not a key")
        elif k in keys:
            issue("duplicate-key", path, f"{k} stands twice")
        else:
            keys.add(k)

    def number(v: object, path: str, per: float = EMU_PER_POINT, positive: bool = False) -> bool:
        try:
            if isinstance(v, bool) or not isinstance(v, int | float):
                raise ValueError
            units(v, per, positive)
        except (ValueError, OverflowError):
            issue("invalid-number", path, "not a number that can be stored")
            return False
        return True

    def text(t: object, path: str) -> None:
        if not isinstance(t, str) or not xml_safe(t):
            issue("invalid-text", path, "not text that XML can hold")
        else:
            totals["text_nodes"] += 1
            totals["code_units"] += utf16_length(t)

    def color(c: object, path: str) -> None:
        if c is not None and not (isinstance(c, str) and hex_color(c)):
            issue("invalid-color", path, "not #RRGGBB")

    def space(t: dict, path: str) -> None:
        for k in ("x", "y"):
            number(t.get(k), f"{path}.{k}")
        for k in ("width", "height"):
            if number(t.get(k), f"{path}.{k}") and t[k] < 0:
                issue("invalid-number", f"{path}.{k}", "below 0")

    def transform(t: object, path: str, group: bool) -> None:
        if not a_dict(t, path):
            return
        closed(t, TRANSFORM_KEYS | ({"childSpace"} if group else set()), path)
        space(t, path)
        if t.get("rotation") is not None:
            number(t["rotation"], f"{path}.rotation", 60000)
        flags(t, ("flipHorizontal", "flipVertical"), path)
        if t.get("childSpace") is not None:
            child_space(t["childSpace"], f"{path}.childSpace")

    def child_space(c: object, path: str) -> None:
        if a_dict(c, path):
            closed(c, {"height", "width", "x", "y"}, path)
            space(c, path)

    def run_properties(p: object, path: str) -> None:
        if p is None or not a_dict(p, path):
            return
        closed(p, RUN_KEYS, path)
        flags(p, ("bold", "italic", "strike", "underline"), path)
        strings(p, ("fontFamily", "language"), path)
        color(p.get("color"), f"{path}.color")
        if p.get("fontSize") is not None:
            number(p["fontSize"], f"{path}.fontSize", 100, True)

    def paragraphs(ps: object, path: str) -> None:
        if not isinstance(ps, list):
            issue("invalid-value", path, "not a list")
            return
        for i, p in enumerate(ps):
            at = f"{path}[{i}]"
            totals["paragraphs"] += 1
            if not a_dict(p, at):
                continue
            closed(p, PARAGRAPH_KEYS, at)
            key(p, at)
            choice(p, "align", at)
            if p.get("level") is not None and (isinstance(p["level"], bool) or not isinstance(p["level"], int) or not 0 <= p["level"] <= 8):
                issue("invalid-number", f"{at}.level", "not a whole number from 0 to 8")
            run_properties(p.get("endProperties"), f"{at}.endProperties")
            for j, c in enumerate(p.get("children") or []):
                node = f"{at}.children[{j}]"
                if not a_dict(c, node):
                    continue
                key(c, node)
                kind = c.get("type", "run")
                if kind not in NODE_KEYS:
                    issue("invalid-value", f"{node}.type", "neither run, field nor break")
                    continue
                closed(c, NODE_KEYS[kind], node)
                if kind != "break":
                    text(c.get("text"), f"{node}.text")
                flags(c, ("preserveSpace",), node)
                strings(c, ("fieldType", "id"), node)
                run_properties(c.get("properties"), f"{node}.properties")

    def body(b: object, path: str) -> None:
        if b is not None and a_dict(b, path):
            closed(b, {"anchor", "autoFit", "vertical", "wrap"}, path)
            choice(b, "anchor", path)
            choice(b, "autoFit", path)
            flags(b, ("vertical", "wrap"), path)

    def placeholder(p: object, path: str) -> None:
        if not a_dict(p, path):
            return
        closed(p, PLACEHOLDER_KEYS, path)
        flags(p, ("hasCustomPrompt",), path)
        strings(p, ("prompt", "type"), path)
        choice(p, "role", path, True)
        choice(p, "orientation", path)
        choice(p, "size", path)
        if p.get("index") is not None and (isinstance(p["index"], bool) or not isinstance(p["index"], int) or p["index"] < 0):
            issue("invalid-number", f"{path}.index", "not a whole number from 0")
        if p.get("sourceKey") is not None:
            references.append((f"{path}.sourceKey", p["sourceKey"]))
        if creates:
            issue("unsupported-feature", path, "placeholders can't be written")

    def element(e: object, path: str) -> None:
        totals["elements"] += 1
        if not a_dict(e, path):
            return
        if id(e) in seen:
            issue("invalid-value", path, "the element stands in two places")
            return
        seen.add(id(e))
        key(e, path)
        kind = e.get("type")
        if kind not in ELEMENT_TYPES or kind == "unsupported" and creates:
            issue("unsupported-element", path, f"{kind} can't be written")
            return
        if profile == "create-text" and kind != "text":
            issue("unsupported-feature", path, "only text boxes can be written")
        closed(e, BASE_KEYS | OWN_KEYS[kind], path)
        strings(e, ("description", "name", "title"), path)
        look = e
        if e.get("authored") is not None and a_dict(e["authored"], f"{path}.authored"):
            look = e["authored"]
            closed(look, AUTHORED_KEYS, f"{path}.authored")
        flags(look, ("hidden",), path)
        strings(look, ("geometry",), path)
        if look.get("lineWidth") is not None:
            number(look["lineWidth"], f"{path}.lineWidth", EMU_PER_POINT, True)
        if kind != "unsupported":
            transform(e.get("transform"), f"{path}.transform", kind == "group")
        for c in ("fillColor", "lineColor"):
            color(look.get(c), f"{path}.{c}")
        if e.get("placeholder") is not None:
            placeholder(e["placeholder"], f"{path}.placeholder")
        if kind in ("text", "shape"):
            body(e.get("body"), f"{path}.body")
            paragraphs(e.get("paragraphs") or [], f"{path}.paragraphs")
        elif kind == "image":
            if e.get("mediaKey") not in media:
                issue("missing-reference", f"{path}.mediaKey", f"no media {e.get('mediaKey')}")
        elif kind == "group":
            if e.get("childSpace") is not None:
                child_space(e["childSpace"], f"{path}.childSpace")
            for i, c in enumerate(e.get("elements") or []):
                element(c, f"{path}.elements[{i}]")
        elif kind == "chart":
            choice(e, "barDirection", path)
            choice(e, "grouping", path)
            flags(e, ("marker",), path)
            chart(e, path)
        elif kind == "table":
            flags(e, tuple(sorted(OWN_KEYS["table"] - {"columns", "rows"})), path)
            table(e, path)

    def chart(e: dict, path: str) -> None:
        kind, series = (e.get("chartType") or "").removesuffix("Chart"), e.get("series") or []
        if kind not in WRITABLE_CHARTS:
            issue("invalid-value", f"{path}.chartType", f"{kind} charts can't be written")
        if not 1 <= len(series) <= SERIES or kind in ("pie", "doughnut") and len(series) != 1:
            issue("invalid-value", f"{path}.series", "wrong number of series")
        points = 0
        for i, s in enumerate(series):
            key(s, f"{path}.series[{i}]")
            color(s.get("color"), f"{path}.series[{i}].color")
            if len(s.get("categories") or []) != len(s.get("values") or []) or (s.get("categories") or []) != (series[0].get("categories") or []):
                issue("invalid-value", f"{path}.series[{i}]", "categories and values differ")
            if any(not isinstance(v, int | float) or not math.isfinite(v) for v in s.get("values") or []):
                issue("invalid-number", f"{path}.series[{i}].values", "not finite")
            points += len(s.get("values") or [])
        totals["chart_points"] += points
        if points > SERIES_POINTS:
            issue("resource-limit", f"{path}.series", f"more than {SERIES_POINTS} points")
        if kind == "doughnut" and not 10 <= (e.get("holeSize") or 50) <= 90:
            issue("invalid-value", f"{path}.holeSize", "not from 10 to 90")
        if (e.get("transform") or {}).get("rotation"):
            issue("invalid-value", f"{path}.transform.rotation", "charts can't be rotated")

    def table(e: dict, path: str) -> None:
        cols, rows = e.get("columns") or [], e.get("rows") or []
        if not cols or not rows:
            issue("invalid-value", path, "no columns or no rows")
            return
        good = all([number(w, f"{path}.columns[{i}]", EMU_PER_POINT, True) for i, w in enumerate(cols)] + [number(r.get("height"), f"{path}.rows[{i}].height", EMU_PER_POINT, True) for i, r in enumerate(rows)])
        whole = lambda xs: sum(int(js_round(x * EMU_PER_POINT)) for x in xs)
        t = e.get("transform") or {}
        if good and isinstance(t.get("width"), int | float) and (whole(cols) != whole([t["width"]]) or whole([r["height"] for r in rows]) != whole([t.get("height", 0)])):
            issue("invalid-value", f"{path}.transform", "columns and rows don't add up to the box")
        taken: dict[tuple[int, int], tuple[int, int]] = {}
        for i, r in enumerate(rows):
            if len(r.get("cells") or []) != len(cols):
                issue("invalid-value", f"{path}.rows[{i}].cells", "not a cell for each column")
                return
            for j, c in enumerate(r["cells"]):
                closed(c, CELL_KEYS, f"{path}.rows[{i}].cells[{j}]")
                for side, line in (c.get("borders") or {}).items():
                    if side not in ("bottom", "left", "right", "top") or not isinstance(line, dict) or line.get("color") is None:
                        issue("invalid-value", f"{path}.rows[{i}].cells[{j}].borders.{side}", "a side with a colour")
                    else:
                        color(line["color"], f"{path}.rows[{i}].cells[{j}].borders.{side}.color")
                if c.get("paragraphs") is not None:
                    paragraphs(c["paragraphs"], f"{path}.rows[{i}].cells[{j}].paragraphs")
                text(c.get("text") or "", f"{path}.rows[{i}].cells[{j}].text")
                color(c.get("fillColor"), f"{path}.rows[{i}].cells[{j}].fillColor")
                rs, cs = c.get("rowSpan") or 1, c.get("colSpan") or 1
                if rs < 1 or cs < 1 or i + rs > len(rows) or j + cs > len(cols):
                    issue("invalid-merge", f"{path}.rows[{i}].cells[{j}]", "the span leaves the table")
                    continue
                for y in range(i, i + rs):
                    for x in range(j, j + cs):
                        if rs * cs > 1:
                            if (y, x) in taken:
                                issue("invalid-merge", f"{path}.rows[{i}].cells[{j}]", "spans overlap")
                            taken[y, x] = (i, j)
        for i, r in enumerate(rows):
            for j, c in enumerate(r["cells"]):
                at = taken.get((i, j))
                want = (at is not None and at[0] < i, at is not None and at[1] < j)
                if (bool(c.get("vMerge")), bool(c.get("hMerge"))) != want:
                    issue("invalid-merge", f"{path}.rows[{i}].cells[{j}]", "merge flags don't fit the spans")

    seen: set[int] = set()
    references: list[tuple[str, object]] = []
    for k in sorted(set(scene) - SCENE_KEYS):
        issue("unknown-key", k, f"{k} is not part of a scene")
    size = scene.get("size") or {}
    for k in ("width", "height"):
        number(size.get(k), f"size.{k}", EMU_PER_POINT, True)
    media = {}
    for i, m in enumerate(scene.get("media") or []):
        key(m, f"media[{i}]")
        media[m.get("key")] = m
        data = m.get("data") or b""
        totals["media"] += 1
        totals["all_media_bytes"] += len(data)
        if len(data) > LIMITS["media_bytes"]:
            issue("resource-limit", f"media[{i}]", "too large")
        if signature(data) != m.get("mimeType"):
            issue("invalid-media", f"media[{i}].data", "the bytes are not of the type")
    levels = [scene.get(k) or [] for k in ("themes", "masters", "layouts")]
    if any(levels) and creates:
        issue("unsupported-feature", "themes", "packages get a minimal hierarchy of their own")
    if any(levels) and not all(levels):
        issue("invalid-hierarchy", "themes", "themes, masters and layouts come together or not at all")
    for name, parent, ref in (("masters", "themes", "themeKey"), ("layouts", "masters", "masterKey")):
        known = {x.get("key") for x in scene.get(parent) or []}
        for i, x in enumerate(scene.get(name) or []):
            if x.get(ref) not in known:
                issue("missing-reference", f"{name}[{i}].{ref}", f"no {x.get(ref)}")
    for name, group, own in zip(("themes", "masters", "layouts"), levels, (set(), {"elements", "themeKey"}, {"elements", "masterKey"}), strict=True):
        for i, x in enumerate(group):
            closed(x, {"key", "name"} | own, f"{name}[{i}]")
            key(x, f"{name}[{i}]")
            for j, e in enumerate(x.get("elements") or []):
                element(e, f"{name}[{i}].elements[{j}]")
    layouts = {x.get("key") for x in scene.get("layouts") or []}
    for i, s in enumerate(scene.get("slides") or []):
        totals["slides"] += 1
        closed(s, {"backgroundColor", "elements", "hidden", "key", "layoutKey", "name"}, f"slides[{i}]")
        key(s, f"slides[{i}]")
        flags(s, ("hidden",), f"slides[{i}]")
        color(s.get("backgroundColor"), f"slides[{i}].backgroundColor")
        if layouts and s.get("layoutKey") not in layouts or not layouts and s.get("layoutKey") is not None:
            issue("missing-reference", f"slides[{i}].layoutKey", f"no layout {s.get('layoutKey')}")
        for j, e in enumerate(s.get("elements") or []):
            element(e, f"slides[{i}].elements[{j}]")
    for path, ref in references:
        if ref not in keys:
            issue("missing-reference", path, f"no {ref}")
    for k, most in LIMITS.items():
        if totals[k] > most:
            issue("resource-limit", k, f"{totals[k]} {k}, more than {most}")
    return out


# Scenes that are rows.


def duplicate_keys(rows: DataFrame, scene: str, key: str, order: str) -> DataFrame:
    """(scene, key, order) of each use of a key after its first in the scene."""
    n = F.row_number().over(Window.partitionBy(scene, key).orderBy(order))
    return rows.withColumn("__n", n).where("__n > 1").select(scene, key, order)


def bad_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(~F.col(key).rlike(KEY) | F.col(key).isNull())


def dangling(rows: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose reference names no target; null references name none and need none."""
    return rows.where(F.col(on[-1]).isNotNull()).join(targets.select(*on).distinct(), on, "left_anti")


def overlapping_spans(cells: DataFrame, table: str) -> DataFrame:
    """(table, row_no, col_no) that two spans or more cover. cells: table, row_no, col_no, row_span, col_span."""
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.greatest(F.lit(1), F.coalesce(F.col(n), F.lit(1))) - 1)
    covered = cells.where("coalesce(row_span, 1) * coalesce(col_span, 1) > 1").withColumn("y", F.explode(span("row_no", "row_span"))).withColumn("x", F.explode(span("col_no", "col_span")))
    return covered.groupBy(table, F.col("y").alias("row_no"), F.col("x").alias("col_no")).count().where("count > 1").drop("count")


def over_limits(totals: DataFrame, scene: str) -> DataFrame:
    """(scene, code, name, total) of totals beyond a creation limit. totals: scene, name, total."""
    limits = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    return totals.where(F.col("total") > F.element_at(limits, F.col("name"))).select(scene, F.lit("resource-limit").alias("code"), "name", "total")
