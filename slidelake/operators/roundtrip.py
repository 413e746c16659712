"""Snapshots, edits and restores: the package's bytes stay as they are but for the parts that an operation names.

A snapshot is plain data: the package in base64 with its digest, a preview of its slides, operations, and hashes of each. Restoring without operations gives the same bytes (level R0); with operations, only the slides they name are rewritten, and the result is parsed again and compared with what the operations should give (level R2).
"""

from __future__ import annotations

import base64
import copy
import json
import math
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions import ooxml
from slidelake.operators.writer import zip_package
from slidelake.sources.deck import Options, parse_deck
from slidelake.operators.validate import WRITABLE_CHARTS
from slidelake.sources.package import Package, PackageError, open_package

# Fixed values.
SCHEMA_VERSION, FORMAT = 1, "pptx"
TEXT_KEY = re.compile(r"slide-(\d+)((?:-element-\d+)+)(?:-row-(\d+)-cell-(\d+))?-run-1$")
SHAPE_KEY = re.compile(r"slide-(\d+)((?:-element-\d+)+)$")
OWNERS = ("p:sp", "p:pic", "p:graphicFrame", "p:grpSp", "p:cxnSp")
ROOT_KEYS = {"schemaVersion", "format", "source", "document", "operations", "consistency", "supportProfile"}
SOURCE_KEYS, CONSISTENCY_KEYS, PROFILE_KEYS = {"byteLength", "conformance", "kind", "packageBase64", "sha256"}, {"source", "document", "operations"}, {"level", "format"}
OPERATION_KEYS = {"replace-text": {"id", "kind", "targetKey", "expectedText", "value"}, "set-transform": {"id", "kind", "targetKey", "expectedTransform", "value"}}
DEPTH, CONTAINERS, CODE_UNITS = 64, 1_000_000, 256 << 20
# End of fixed values.


class EditError(ValueError):
    """An edit or a restore that can't be done: code and message."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def preview(row: dict) -> list[dict]:
    """Elements of the slides with key, type, transform and text, the cells of tables and the series of charts. What no operation knows is `unsupported`, with the feature's name and its text."""
    cells: dict[tuple, list] = {}
    for c in row.get("table_cells", []):
        cells.setdefault((c["slide_no"], c["key"]), []).append({"key": f"{c['key']}-row-{c['row_no'] + 1}-cell-{c['col_no'] + 1}-run-1", "text": c["text"]})
    series: dict[tuple, dict[int, dict]] = {}
    for c in row.get("chart_points", []):
        own = series.setdefault((c["slide_no"], c["key"]), {}).setdefault(c["series_no"], {"key": f"{c['key']}-series-{c['series_no'] + 1}", "name": c["series_name"], "categories": [], "values": []})
        own["categories"].append(c["category"] if c["category"] is not None else str(c["idx"]))
        own["values"].append(c["y"])
        if ooxml.hex_color(c["series_color"]) and len(c["series_color"]) == 7:
            own["color"] = c["series_color"]
    out = []
    for e in row.get("elements", []):
        if e["origin"] == "slide":
            t = {k: e[s] for k, s in (("x", "left"), ("y", "top"), ("width", "width"), ("height", "height"), ("rotation", "rotate"), ("flipHorizontal", "flip_h"), ("flipVertical", "flip_v"))}
            item = {"key": e["key"], "type": e["type"], "transform": t}
            if e["type"] in ("text", "shape") and e.get("plain_text"):
                item["runs"] = [{"key": f"{e['key']}-run-1", "text": e["plain_text"]}]
            elif e["type"] == "table":
                item["runs"] = cells.get((e["slide_no"], e["key"]), [])
            elif e["type"] == "chart" and (e["chart_type"] or "").removesuffix("Chart") in WRITABLE_CHARTS:
                item |= {"chartType": e["chart_type"], "series": list(series.get((e["slide_no"], e["key"]), {}).values())}
            elif e["type"] not in ("text", "shape", "image", "group"):
                item |= {"type": "unsupported", "feature": e["chart_type"] or e["type"], "previewText": e.get("plain_text") or ""}
            out.append(item)
    return out


#: The tables that previews and edits look at.
LOOKED_AT = Options(strict=True, tables=frozenset({"slides", "elements", "table_cells", "chart_points"}))


def _strictly(raw: bytes) -> dict:
    row = parse_deck(raw, "", LOOKED_AT)
    if row["status"] != "ok":
        raise PackageError(row["code"], row["message"])
    return row


def read_snapshot(raw: bytes) -> dict:
    """A snapshot without operations. PackageError: the package does not parse strictly."""
    return _snapshot(raw, _strictly(raw))


def _snapshot(raw: bytes, row: dict) -> dict:
    source = {"kind": "package", "byteLength": len(raw), "sha256": row["deck_id"], "conformance": row["conformance"], "packageBase64": base64.b64encode(raw).decode()}
    return _sealed({"schemaVersion": SCHEMA_VERSION, "format": FORMAT, "source": source, "document": preview(row), "operations": []})


def _sealed(s: dict) -> dict:
    """The snapshot with its support profile and hashes."""
    level = "R2" if s["operations"] else "R0"
    bare = {k: s["source"][k] for k in ("byteLength", "conformance", "kind", "sha256")}
    s["supportProfile"] = {"level": level, "format": FORMAT}
    keys, cells = [e["key"] for e in s["document"]], [r["key"] for e in s["document"] if e["type"] == "table" for r in e.get("runs", [])]
    s["consistency"] = {"source": ooxml.canonical_hash({"source": bare, "keys": keys, "cells": cells, "format": FORMAT}), "document": ooxml.canonical_hash(s["document"]), "operations": ooxml.canonical_hash(s["operations"])}
    return s


TRANSFORM = {"x": float, "y": float, "width": float, "height": float, "rotation": float, "flipHorizontal": bool, "flipVertical": bool}


def _operation(document: list[dict], kind: str, key: str, value: object) -> dict:
    """An operation on a preview, checked. EditError: no such target, nothing changes, or the value can't be stored."""
    if kind == "replace-text":
        run = next((r for e in document for r in e.get("runs", []) if r["key"] == key), None)
        if run is None:
            raise EditError("missing-target", f"no run {key}")
        if not isinstance(value, str) or not ooxml.xml_safe(value):
            raise EditError("invalid-text", "not text that XML can hold")
        if value == run["text"]:
            raise EditError("no-change", "the text is the same")
        return {"kind": kind, "targetKey": key, "expectedText": run["text"], "value": value}
    if kind != "set-transform":
        raise EditError("invalid-operation", f"no operation {kind}")
    e = next((e for e in document if e["key"] == key), None)
    if e is None:
        raise EditError("missing-target", f"no element {key}")
    if not isinstance(value, dict) or not set(value) <= set(TRANSFORM) or any(isinstance(v, bool) != (TRANSFORM[k] is bool) or not isinstance(v, int | float) for k, v in value.items()):
        raise EditError("invalid-value", "not a transform")
    new = e["transform"] | value
    try:
        for k in ("x", "y", "width", "height"):
            ooxml.points_to_emu(new[k])
        ooxml.units(new["rotation"], 60000)
    except (ValueError, OverflowError) as error:
        raise EditError("invalid-value", str(error)) from None
    if new["width"] < 0 or new["height"] < 0:
        raise EditError("invalid-value", "sizes can't be below 0")
    if new == e["transform"]:
        raise EditError("no-change", "the transform is the same")
    return {"kind": kind, "targetKey": key, "expectedTransform": e["transform"], "value": new}


def edited(snapshot: dict, operations: Iterable[tuple[str, str, object]]) -> dict:
    """The snapshot with operations (kind, key of the target, value), one for a target. The preview stays at the source's state, and the hashes are made once."""
    ops = list(snapshot["operations"])
    taken = {o["targetKey"] for o in ops}
    for kind, key, value in operations:
        if key in taken:
            raise EditError("target-taken", f"{key} has an operation already")
        taken.add(key)
        ops.append({"id": f"op-{len(ops) + 1}", **copy.deepcopy(_operation(snapshot["document"], kind, key, value))})
    return _sealed(copy.deepcopy(snapshot | {"operations": ops}))


def replace_text(snapshot: dict, key: str, value: str) -> dict:
    """The snapshot with an operation that gives a run another text."""
    return edited(snapshot, [("replace-text", key, value)])


def set_transform(snapshot: dict, key: str, value: dict) -> dict:
    """The snapshot with an operation that moves, sizes, turns or flips an element; keys that value leaves out stay."""
    return edited(snapshot, [("set-transform", key, value)])


def to_json(snapshot: dict) -> str:
    restore(snapshot)
    return ooxml.canonical_json(snapshot)


def from_json(text: str) -> dict:
    """A snapshot from its JSON, verified as restoring verifies it. EditError: wrong shape, version, digest or operation."""
    try:
        s = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise EditError("invalid-json", str(e)) from None
    restore(s)
    return s


def check_tree(value: object) -> None:
    """EditError unless value is a tree of plain JSON data: no deeper, larger or longer than a snapshot may be, every number finite, nothing in two places."""
    open_: list[tuple[object, int]] = [(value, 0)]
    seen: set[int] = set()
    units = 0
    while open_:
        x, depth = open_.pop()
        if depth > DEPTH:
            raise EditError("invalid-snapshot", f"deeper than {DEPTH}")
        if isinstance(x, str):
            units += ooxml.utf16_length(x)
        elif isinstance(x, dict | list):
            if id(x) in seen:
                raise EditError("invalid-snapshot", "an object stands in two places")
            seen.add(id(x))
            if isinstance(x, dict):
                if not all(isinstance(k, str) for k in x):
                    raise EditError("invalid-snapshot", "a key that is no text")
                units += sum(map(ooxml.utf16_length, x))
            open_ += [(v, depth + 1) for v in (x.values() if isinstance(x, dict) else x)]
        elif not (x is None or isinstance(x, bool) or isinstance(x, int | float) and math.isfinite(x)):
            raise EditError("invalid-snapshot", "not a JSON value")
        if len(seen) > CONTAINERS or units > CODE_UNITS:
            raise EditError("invalid-snapshot", "too much data")


def check_shape(s: object) -> None:
    """EditError unless s has the shape of a snapshot of this version, operations included."""

    def has(x: object, keys: set[str], what: str) -> None:
        if not isinstance(x, dict) or set(x) != keys:
            raise EditError("invalid-snapshot", f"{what} is not of this version")

    has(s, ROOT_KEYS, "the snapshot")
    if s["schemaVersion"] != SCHEMA_VERSION or s["format"] != FORMAT:
        raise EditError("invalid-snapshot", "not a snapshot of this version")
    has(s["source"], SOURCE_KEYS, "the source")
    has(s["consistency"], CONSISTENCY_KEYS, "the hashes")
    has(s["supportProfile"], PROFILE_KEYS, "the profile")
    if not isinstance(s["document"], list) or not isinstance(s["operations"], list) or not isinstance(s["source"]["packageBase64"], str):
        raise EditError("invalid-snapshot", "not a snapshot of this version")
    for i, op in enumerate(s["operations"], 1):
        has(op, OPERATION_KEYS.get(op.get("kind") if isinstance(op, dict) else None, set()), "an operation")
        if op["id"] != f"op-{i}" or not isinstance(op["targetKey"], str):
            raise EditError("invalid-snapshot", "an operation is not in its place")
    if len({op["targetKey"] for op in s["operations"]}) < len(s["operations"]):
        raise EditError("target-taken", "two operations have one target")


def slide_parts(package: Package) -> dict[int, str]:
    """The parts of the slides by number, as an edit needs them: every slide of the list must name a part of the package by a slide's relationship."""
    main = "ppt/presentation.xml"
    root, rels = package.xml(main), {}
    for r in package.relationships(main):
        if r["type"].rpartition("/")[2] == "slide" and not r["is_external"] and r["target"] in package.archive.NameToInfo:
            rels[r["rid"]] = r["target"]
    ids = root.child("p:sldIdLst").all("p:sldId") if root and root.child("p:sldIdLst") else []
    out = {n: rels.get(x.attrs.get("r:id", "")) for n, x in enumerate(ids, 1)}
    if None in out.values():
        raise EditError("unsupported-package", "the order of the slides can't be told")
    return out  # type: ignore[return-value]


# The source XML.


class _Ranges:
    """Byte offsets of elements, from a pass over the part's bytes: (tag, attributes, start, end, inner start, inner end, parent)."""

    def __init__(self, raw: bytes):
        self.raw, self.items, self.stack = raw, [], []
        p = self.parser = expat.ParserCreate(namespace_separator=" ")
        p.StartElementHandler, p.EndElementHandler = self._start, self._end
        p.Parse(raw, True)

    def _start(self, name: str, attrs: dict) -> None:
        i = self.parser.CurrentByteIndex
        self.items.append({"tag": name.rpartition(" ")[2], "attrs": attrs, "start": i, "end": None, "close": None, "parent": self.stack[-1] if self.stack else None})
        self.stack.append(len(self.items) - 1)

    def _end(self, _: str) -> None:
        item = self.items[self.stack.pop()]
        i = self.parser.CurrentByteIndex
        close = self.raw[i : i + 2] == b"</"
        item["close"] = i if close else None
        item["end"] = self.raw.index(b">", i) + 1 if close else self._tag_end(item["start"])
        item["open_end"] = self._tag_end(item["start"])

    def _tag_end(self, at: int) -> int:
        quote = None
        for i in range(at, len(self.raw)):
            c = self.raw[i : i + 1]
            if quote:
                quote = None if c == quote else quote
            elif c in (b'"', b"'"):
                quote = c
            elif c == b">":
                return i + 1
        raise EditError("invalid-xml", "a tag does not end")

    def inside(self, owner: int, tag: str) -> list[int]:
        """Elements of a name anywhere inside another."""
        a = self.items[owner]
        return [i for i, x in enumerate(self.items) if x["tag"] == tag and a["start"] < x["start"] < a["end"]]

    def child(self, owner: int, *path: str) -> int | None:
        for tag in path:
            owner = next((i for i, x in enumerate(self.items) if x["parent"] == owner and x["tag"] == tag), None)
            if owner is None:
                return None
        return owner


_LOCAL_OWNERS = tuple(o[2:] for o in OWNERS)


def _locate(r: _Ranges, path: list[int]) -> int:
    """The element at a path of positions among the drawable ones."""
    at = next(i for i, x in enumerate(r.items) if x["tag"] == "spTree")
    for n in path:
        own = [i for i, x in enumerate(r.items) if x["parent"] == at and x["tag"] in _LOCAL_OWNERS]
        if n > len(own):
            raise EditError("missing-target", "no such element in the slide")
        at = own[n - 1]
    return at


def _spliced(raw: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    for a, b, new in sorted(edits, reverse=True):
        raw = raw[:a] + new + raw[b:]
    return raw


def _patched_text(raw: bytes, path: list[int], cell: tuple[int, int] | None, expected: str, value: str) -> bytes:
    r = _Ranges(raw)
    owner = _locate(r, path)
    if cell:
        rows = r.inside(owner, "tr")
        cells = [i for i in r.inside(rows[cell[0] - 1], "tc")]
        owner = cells[cell[1] - 1]
    if any(r.inside(owner, t) for t in ("br", "fld", "AlternateContent")):
        raise EditError("unsupported-text", "the text has breaks, fields or alternatives")
    nodes = r.inside(owner, "t")
    if len(nodes) != 1 or r.items[nodes[0]]["close"] is None:
        raise EditError("unsupported-text", "the text is not one run")
    t = r.items[nodes[0]]
    source = ooxml.decode_office(ooxml.decode_entities(raw[t["open_end"] : t["close"]].decode("utf-8")))
    if source != expected:
        raise EditError("precondition-failed", "the source has another text")
    edits = [(t["open_end"], t["close"], ooxml.escape_xml(value).encode("utf-8"))]
    if ooxml.needs_preserve(value) and b"xml:space" not in raw[t["start"] : t["open_end"]]:
        edits.append((t["open_end"] - 1, t["open_end"] - 1, b' xml:space="preserve"'))
    return _spliced(raw, edits)


def _patched_transform(raw: bytes, path: list[int], expected: dict, value: dict) -> bytes:
    r = _Ranges(raw)
    if len(path) > 1:
        raise EditError("unsupported-transform", "elements of groups are edited through their group")
    owner = _locate(r, path)
    kind = r.items[owner]["tag"]
    x = r.child(owner, "xfrm") if kind == "graphicFrame" else r.child(owner, "grpSpPr" if kind == "grpSp" else "spPr", "xfrm")
    off, ext = (r.child(x, k) if x is not None else None for k in ("off", "ext"))
    if off is None or ext is None:
        raise EditError("unsupported-transform", "the element has no transform of its own")
    edits = []
    for i, keys in ((off, (("x", "x"), ("y", "y"))), (ext, (("cx", "width"), ("cy", "height")))):
        item = r.items[i]
        tag = raw[item["start"] : item["open_end"]]
        for attr, k in keys:
            if ooxml.emu_to_points(int(item["attrs"][attr])) != expected[k]:
                raise EditError("precondition-failed", f"the source has another {k}")
            if value[k] != expected[k]:
                tag = re.sub(rb"(\s" + attr.encode() + rb"\s*=\s*)([\"'])[^\"']*\2", lambda m, k=k: m[1] + b'"' + str(ooxml.points_to_emu(value[k])).encode() + b'"', tag)
        edits.append((item["start"], item["open_end"], tag))
    item = r.items[x]
    head = raw[item["start"] : item["open_end"]]
    for attr, k, text in (("rot", "rotation", lambda v: str(ooxml.units(v, 60000))), ("flipH", "flipHorizontal", lambda v: str(int(v))), ("flipV", "flipVertical", lambda v: str(int(v)))):
        if value[k] != expected[k]:
            head = re.sub(rb"\s" + attr.encode() + rb"\s*=\s*([\"'])[^\"']*\1", b"", head)
            head = re.sub(rb"(/?>)$", f' {attr}="{text(value[k])}"'.encode() + rb"\1", head)
    edits.append((item["start"], item["open_end"], head))
    if kind == "graphicFrame" and (grid := r.inside(owner, "gridCol")):
        for members, attr, k in ((grid, "w", "width"), (r.inside(owner, "tr"), "h", "height")):
            if value[k] != expected[k]:
                sizes = ooxml.scaled_grid([int(r.items[i]["attrs"][attr]) for i in members], ooxml.points_to_emu(value[k]))
                for i, s in zip(members, sizes, strict=True):
                    g = r.items[i]
                    edits.append((g["start"], g["open_end"], re.sub(rb"(\s" + attr.encode() + rb"\s*=\s*)([\"'])[^\"']*\2", rb'\g<1>"' + str(s).encode() + b'"', raw[g["start"] : g["open_end"]])))
    return _spliced(raw, edits)


def applied(document: list[dict], operations: list[dict]) -> list[dict]:
    """The preview after the operations; children of a group that changed move and scale with it."""
    out = copy.deepcopy(document)
    by_key = {e["key"]: e for e in out}
    for op in operations:
        if op["kind"] == "replace-text":
            for e in out:
                for run in e.get("runs", []):
                    if run["key"] == op["targetKey"]:
                        run["text"] = op["value"]
        else:
            e = by_key[op["targetKey"]]
            old, new = e["transform"], op["value"]
            e["transform"] = new
            if e["type"] == "group":
                sx = new["width"] / old["width"] if old["width"] else 1
                sy = new["height"] / old["height"] if old["height"] else 1
                for k, c in by_key.items():
                    if k.startswith(op["targetKey"] + "-element-"):
                        t = c["transform"]
                        t |= {"x": ooxml.to_fixed(new["x"] + (t["x"] - old["x"]) * sx), "y": ooxml.to_fixed(new["y"] + (t["y"] - old["y"]) * sy), "width": ooxml.to_fixed(t["width"] * sx), "height": ooxml.to_fixed(t["height"] * sy)}
    return out


def restore(snapshot: dict) -> bytes:
    """The package: the source's bytes, or those with the operations applied, verified. EditError: any check fails."""
    check_tree(snapshot)
    check_shape(snapshot)
    source = snapshot["source"]
    try:
        raw = ooxml.strict_base64(source["packageBase64"])
    except ValueError as e:
        raise EditError("invalid-source", str(e)) from None
    if ooxml.sha256(raw) != source["sha256"] or len(raw) != source["byteLength"]:
        raise EditError("digest-mismatch", "the package is not the one that was read")
    row = _strictly(raw)
    fresh = _snapshot(raw, row)
    claimed = _sealed(copy.deepcopy({k: v for k, v in snapshot.items() if k not in ("consistency", "supportProfile")}))
    if claimed["consistency"] != snapshot["consistency"] or claimed["supportProfile"] != snapshot["supportProfile"]:
        raise EditError("hash-mismatch", "the hashes don't fit the content")
    if fresh["document"] != snapshot["document"] or fresh["consistency"]["source"] != snapshot["consistency"]["source"]:
        raise EditError("document-mismatch", "the preview is not the package's")
    return _applied(raw, row, snapshot)


def _applied(raw: bytes, row: dict, snapshot: dict) -> bytes:
    """The package with the operations of its snapshot; what comes out is parsed and compared with the preview after them."""
    if not snapshot["operations"]:
        return raw
    package = open_package(raw, strict=True)
    names = set(package.names)
    if any(n.startswith("_xmlsignatures/") or n.endswith("vbaProject.bin") for n in names):
        raise EditError("unsupported-package", "signed packages and macros are not edited")
    slides = slide_parts(package)
    if slides != {s["slide_no"]: s["part"] for s in row["slides"]}:
        raise EditError("unsupported-package", "some slides are not declared")
    changed: dict[str, bytes] = {}
    for op in snapshot["operations"]:
        text = op["kind"] == "replace-text"
        m = (TEXT_KEY if text else SHAPE_KEY).match(op["targetKey"])
        if not m or int(m[1]) not in slides:
            raise EditError("missing-target", f"no target {op['targetKey']}")
        part = slides[int(m[1])]
        path = [int(x) for x in re.findall(r"-element-(\d+)", m[2])]
        xml = changed.get(part) or package.archive.read(part)
        if text:
            changed[part] = _patched_text(xml, path, (int(m[3]), int(m[4])) if m[3] else None, op["expectedText"], op["value"])
        else:
            changed[part] = _patched_transform(xml, path, op["expectedTransform"], op["value"])
    out = zip_package([(n, changed.get(n) or package.archive.read(n)) for n in package.names])
    again = open_package(out, strict=True)
    if again.names != package.names or any(again.archive.read(n) != package.archive.read(n) for n in names - set(changed)):
        raise EditError("verification-failed", "a part that no operation names has changed")
    if ooxml.canonical_json(preview(_strictly(out))) != ooxml.canonical_json(_as_stored(applied(snapshot["document"], snapshot["operations"]))):
        raise EditError("verification-failed", "the edited package does not read as the operations say")
    return out


def _as_stored(document: list[dict]) -> list[dict]:
    """Numbers as the format holds them: whole EMU and whole degrees."""
    for e in document:
        t = e["transform"]
        for k in ("x", "y", "width", "height"):
            t[k] = ooxml.emu_to_points(ooxml.points_to_emu(t[k]))
        t["rotation"] = float(ooxml.degrees(ooxml.units(t["rotation"], 60000)))
    return document


def _value(kind: str, text: str | None) -> object:
    """An operation's value from its column."""
    if kind == "replace-text":
        return text
    try:
        return json.loads(text or "")
    except ValueError as e:
        raise EditError("invalid-json", str(e)) from None


def edit_packages(packages: DataFrame, operations: DataFrame) -> DataFrame:
    """path, content, level, code, message after the operations of each path: rows of path, seq, kind (replace-text or set-transform), target_key and value (text, or a transform as JSON).

    Operations are gathered by path (a deck's own, never a table's) and joined to the packages; a deck without any gives its own bytes at R0. A deck that fails is a row with null content.
    """
    ops = operations.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "target_key", "value"))).alias("ops"))
    joined = packages.select("path", "content").join(ops, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("level", pa.string()), ("code", pa.string()), ("message", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = {"path": row["path"], "content": None, "level": None, "code": None, "message": None}
                try:
                    if (raw := row["content"]) is None:
                        raise EditError("resource-limit", "no content, or more than allowed")
                    parsed = _strictly(raw)
                    s = edited(_snapshot(raw, parsed), [(op["kind"], op["target_key"], _value(op["kind"], op["value"])) for op in row["ops"] or []])
                    out |= {"content": _applied(raw, parsed, s), "level": s["supportProfile"]["level"]}
                except (EditError, PackageError) as e:
                    out |= {"code": e.code, "message": str(e)}
                except Exception as e:  # no content of one package may stop the others
                    out |= {"code": "invalid-content", "message": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return joined.mapInArrow(run, "path string, content binary, level string, code string, message string")
