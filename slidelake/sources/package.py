"""Reading a package: a bounded, fail-closed walk over its ZIP entries and XML parts.

A package is read whole in one task, since its budgets hold for the package. Limits raise in both modes; other faults are diagnostics, or raise in strict mode.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field, fields
from functools import lru_cache
from xml.parsers import expat

from slidelake.functions import ooxml

# Namespaces of both conformance classes and the prefixes that stand for them here.
_OPEN, _STRICT = "http://schemas.openxmlformats.org/", "http://purl.oclc.org/ooxml/"
NAMESPACES = {
    _OPEN + "drawingml/2006/main": "a", _STRICT + "drawingml/main": "a",
    _OPEN + "drawingml/2006/chart": "c", _STRICT + "drawingml/chart": "c",
    _OPEN + "drawingml/2006/diagram": "dgm", _STRICT + "drawingml/diagram": "dgm",
    _OPEN + "officeDocument/2006/math": "m", _STRICT + "officeDocument/math": "m",
    _OPEN + "officeDocument/2006/relationships": "r", _STRICT + "officeDocument/relationships": "r",
    _OPEN + "presentationml/2006/main": "p", _STRICT + "presentationml/main": "p",
    "http://schemas.microsoft.com/office/drawing/2008/diagram": "dsp",
    "http://schemas.microsoft.com/office/drawing/2010/main": "a14",
    "http://schemas.microsoft.com/office/powerpoint/2010/main": "p14",
    _OPEN + "markup-compatibility/2006": "mc",
    _OPEN + "package/2006/content-types": "", _OPEN + "package/2006/relationships": "",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
SLIDE_TYPE = "application/vnd.openxmlformats-officedocument.presentationml.slide+xml"
#: Of the presentation's root, transitional and strict.
PRESENTATION = (_OPEN + "presentationml/2006/main", _STRICT + "presentationml/main")
RELATIONSHIP_TYPES = (_OPEN + "officeDocument/2006/relationships/", _STRICT + "officeDocument/relationships/")
# End of fixed values.

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*(?::[A-Za-z_][A-Za-z0-9_.\-]*)?$")


@lru_cache(4096)
def _is_name(name: str) -> bool:
    return _NAME.match(name) is not None


@dataclass(frozen=True)
class Limits:
    """A package beyond one of these fails."""

    input_bytes: int = 100 << 20
    entries: int = 10_000
    expanded_bytes: int = 256 << 20
    part_bytes: int = 64 << 20
    xml_bytes: int = 16 << 20
    xml_depth: int = 128
    xml_nodes: int = 250_000
    package_nodes: int = 1_000_000
    media_bytes: int = 64 << 20
    slides: int = 1_000

    def __post_init__(self) -> None:
        for f in fields(self):
            if not isinstance(v := getattr(self, f.name), int) or v < 1:
                raise ValueError(f"{f.name} must be a positive whole number")


class PackageError(Exception):
    """A package that can't be read: code and the part, if there is one."""

    def __init__(self, code: str, message: str, part: str | None = None):
        super().__init__(message)
        self.code, self.part = code, part


class Node:
    """An XML element: canonical tag, attributes, children in order, and text if it has nothing else."""

    __slots__ = ("attrs", "children", "namespace", "order", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node] = []
        self.text: str | None = None
        self.order = 0  # post-order: children before their parent
        # namespace: only a root has it

    def child(self, *path: str) -> Node | None:
        """The first element at a path of tags."""
        at = self
        for tag in path:
            for c in at.children:
                if c.tag == tag:
                    at = c
                    break
            else:
                return None
        return at

    def all(self, tag: str) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def get(self, *path: str) -> str | None:
        """The attribute named last at the path before it."""
        at = self.child(*path[:-1])
        return at.attrs.get(path[-1]) if at else None

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


class Shape:
    """What cells that differ in one text at most have in common: their tree, its size and depth, and whether it is all of the main drawing namespace."""

    def __init__(self, root: Node, count: int):
        self.root, self.count = root, count
        self.depth = max(_depths(root, 1))
        self.plain = all(n.tag.startswith("a:") for n in root.walk())


def _depths(node: Node, at: int):
    yield at
    for c in node.children:
        yield from _depths(c, at + 1)


class Cell(Node):
    """An element of a shape and its text; the elements in it are made when they are looked at."""

    __slots__ = ("made", "shape", "value")

    def __init__(self, shape: Shape, value: str, order: int):
        self.shape, self.value, self.order, self.made = shape, value, order, None
        self.tag, self.attrs, self.text = shape.root.tag, shape.root.attrs, None

    @property
    def children(self) -> list[Node]:
        if self.made is None:
            before = self.order - self.shape.count

            def like(n: Node) -> Node:
                out = Node(n.tag, dict(n.attrs))
                out.order, out.children = before + n.order, [like(c) for c in n.children]
                out.text = self.value if n.text is not None else None
                return out

            self.made = [like(c) for c in self.shape.root.children]
        return self.made


#: A table's cell with one text at most and no reference in it: its start, what stands before and behind the text. Cells are told by it only where nothing but tags can begin with "<".
_TEXT = r"[^<>&\x00-\x1f\ufffe\uffff]++"
_CELL = re.compile(rf"(<a:tc(?: [^<>]*)?(?<!/)>(?:<(?!/?a:tc[ />])[^<>]*>)++)((?:{_TEXT})?)((?:<(?!/?a:tc[ />])[^<>]*>)*+</a:tc>)")
#: Shapes of cells of a part that are tried, and cells from which that is worth it.
SHAPES, LEAST_CELLS = 32, 16


def decoded(raw: bytes) -> str:
    """UTF-16 with a byte order mark, else UTF-8; nothing invalid passes."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    return raw.decode("utf-8-sig")


def parse_xml(raw: bytes, limits: Limits = Limits()) -> tuple[Node, int]:
    """The root and the number of elements. PackageError: a limit, a document type, malformed or mixed content, doubled attributes."""
    try:
        text = decoded(raw)
    except UnicodeDecodeError as e:
        raise PackageError("invalid-xml", f"not decodable: {e.reason}") from None
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    if text.count("</a:tc>") >= LEAST_CELLS and "<!" not in text and "<?" not in text:
        try:
            return _parsed(*_folded(text), limits)
        except PackageError:
            pass  # told once more, in the words and with the places of the whole text
    return _parsed(text, [], limits)


def _folded(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with an instruction in the place of each cell whose shape is well formed: the shape's number and, between a dot and "~" with that number, the cell's text; neighbours of one shape share one, with "<" between their texts. The shapes: before the text, a sample of it or nothing, behind it."""
    shapes: list[tuple[str, str, str]] = []
    tried: set[tuple[str, str, bool]] = set()
    at = 0
    while len(tried) < SHAPES and (m := _CELL.search(text, at)):
        before, value, behind = m.groups()
        at = m.end()
        if (key := (before, behind, value == "")) in tried:
            continue
        tried.add(key)
        shape = (before, "x" if value else "", behind)
        try:
            root, _ = _parsed("".join(shape), [], Limits())
        except PackageError:
            continue
        if root.children:
            own = re.compile(f"{re.escape(before)}({_TEXT if value else ''}){re.escape(behind)}")
            at = m.start()
            n = len(shapes)
            text = text[:at] + own.sub(rf"<?cell{n} .\1~{n}?>", text[at:]).replace(f"~{n}?><?cell{n} .", "<")
            shapes.append(shape)
    return text, shapes


def _parsed(text: str, shapes: list[tuple[str, str, str]], limits: Limits, scope: dict[str, str] | None = None) -> tuple[Node, int]:
    """The root and the number of elements of a text, in which instructions stand for cells of the shapes, if there are any."""
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    root: Node | None = None
    at: Node | None = None
    above: list[Node | None] = []  # what is open around `at`
    scope = scope or {"xml": "http://www.w3.org/XML/1998/namespace"}
    tags: dict[str, str] = {}  # canonical names of elements in this scope
    outer: list[tuple[int, dict, dict]] = []  # scopes to come back to, and at which depth
    pieces: list[str] = []  # of text since the last tag
    mixed: list[Node] = []  # open elements with text before a child
    count = order = 0
    most, deepest = limits.xml_nodes, limits.xml_depth

    def canonical(name: str, scope: dict[str, str], attribute: bool) -> str:
        prefix, _, local = name.rpartition(":")
        if attribute and not prefix:
            return name
        uri = scope.get(prefix)
        if uri is None:
            return name  # undeclared prefixes are taken as they stand
        known = NAMESPACES.get(uri)
        if known is not None:
            return f"{known}:{local}" if known else local
        return f"ns_{prefix}:{local}" if prefix in NAMESPACES.values() else name

    def attributes(pairs: list[str]) -> dict[str, str]:
        """Attributes by canonical name. Opens a scope if namespaces are declared."""
        nonlocal scope, tags
        declared, given = {}, []
        for k, v in zip(pairs[::2], pairs[1::2], strict=True):
            if not _is_name(k):
                raise PackageError("invalid-xml", "a name outside the allowed pattern")
            if k == "xmlns" or k.startswith("xmlns:"):
                declared[k[6:]] = v
            else:
                given.append((k, v))
        if declared:
            outer.append((len(above), scope, tags))
            scope, tags = {**scope, **declared}, {}
        attrs: dict[str, str] = {}
        for k, v in given:
            key = canonical(k, scope, True) if ":" in k else k
            if key in attrs:
                raise PackageError("invalid-xml", f"attribute {key} stands twice")
            attrs[key] = v
        return attrs

    def start(name: str, pairs: list[str]) -> None:
        nonlocal root, at, count
        count += 1
        if count > most:
            raise PackageError("resource-limit", f"more than {most} elements")
        if len(above) >= deepest:
            raise PackageError("resource-limit", f"deeper than {deepest}")
        if name not in tags and not _is_name(name):
            raise PackageError("invalid-xml", "a name outside the allowed pattern")
        if pieces:
            if "".join(pieces).strip():
                mixed.append(at)
            pieces.clear()
        above.append(at)
        attrs = attributes(pairs) if pairs else {}
        if (tag := tags.get(name)) is None:
            tag = tags[name] = canonical(name, scope, False)
        node = Node(tag, attrs)
        if at is None:
            root = node
            root.namespace = scope.get(name.rpartition(":")[0], "")
        else:
            at.children.append(node)
        at = node

    def end(_: str) -> None:
        nonlocal at, order, scope, tags
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if not at.children:
                at.text = text
            elif text.strip():
                raise PackageError("invalid-xml", f"text beside elements in {at.tag}")
        if mixed and mixed[-1] is at:
            raise PackageError("invalid-xml", f"text beside elements in {at.tag}")
        order += 1
        at.order = order
        if outer and outer[-1][0] == len(above):
            _, scope, tags = outer.pop()
        at = above.pop()

    here: dict[str, tuple[dict, Shape]] = {}  # shapes in the scope where they were last met

    def cell(name: str, data: str) -> None:
        nonlocal count, order
        known = here.get(name)
        if known is None or known[0] is not scope:
            known = here[name] = (scope, Shape(*_parsed("".join(shapes[int(name.removeprefix("cell"))]), [], limits, scope)))
        shape = known[1]
        values = data[1 : data.rindex("~")].split("<")
        count += shape.count * len(values)
        if at is None or count > most or len(above) + shape.depth > deepest:
            raise PackageError("resource-limit", "no root, too many elements, or too deep")
        if pieces:
            if "".join(pieces).strip():
                mixed.append(at)
            pieces.clear()
        for value in values:
            order += shape.count
            at.children.append(Cell(shape, value, order))

    if shapes:
        parser.ProcessingInstructionHandler = cell

    def doctype(*_: object) -> None:
        raise PackageError("invalid-xml", "document types are not allowed")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, doctype
    parser.CharacterDataHandler = pieces.append
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise PackageError("invalid-xml", str(e)) from None
    return root, count  # type: ignore[return-value]


#: Parts up to so many bytes are parsed once for packages that share them, as themes, masters and layouts often are. Nobody changes a tree, but for those of diagrams, which are not shared.
SHARED = 1 << 16
_shared_xml = lru_cache(64)(parse_xml)


@dataclass
class Package:
    """An open package: part names in archive order, cached parts, diagnostics in order."""

    raw: bytes
    limits: Limits
    strict: bool
    archive: zipfile.ZipFile
    names: list[str]
    diagnostics: list[dict] = field(default_factory=list)
    spent_bytes: int = 0
    spent_nodes: int = 0
    _xml: dict[str, Node | None] = field(default_factory=dict)
    _seen: set[tuple] = field(default_factory=set)

    def report(self, code: str, severity: str, part: str | None, message: str) -> None:
        """A diagnostic, once for a part and code; raises in strict mode."""
        if self.strict:
            raise PackageError(code, message, part)
        if (code, part, message) not in self._seen:
            self._seen.add((code, part, message))
            self.diagnostics.append({"seq": len(self.diagnostics), "code": code, "severity": severity, "part": part, "message": message})

    def read(self, part: str, most: int) -> bytes | None:
        """A part's bytes, None if there is no such part. The stream counts, not the declared size."""
        if part not in self.archive.NameToInfo:
            return None
        left = self.limits.expanded_bytes - self.spent_bytes
        bound = min(most, left)
        try:
            with self.archive.open(part) as f:
                data = f.read(bound + 1)
        except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError) as e:
            self.report("part-read-failed", "error", part, str(e))
            return None
        if len(data) > bound:
            raise PackageError("resource-limit", "part too large" if bound == most else "package expands too far", part)
        self.spent_bytes += len(data)
        return data

    def xml(self, part: str, required: bool = True) -> Node | None:
        """A part's root, parsed once; None with a diagnostic if it is missing (and required) or malformed."""
        if part in self._xml:
            return self._xml[part]
        root = None
        if (data := self.read(part, min(self.limits.xml_bytes, self.limits.part_bytes))) is None:
            if required:
                self.report("missing-part", "error", part, f"{part} is missing")
        else:
            try:
                root, n = _shared_xml(data, self.limits) if len(data) <= SHARED and not part.startswith("ppt/diagrams/") else parse_xml(data, self.limits)
                self.spent_nodes += n
                if self.spent_nodes > self.limits.package_nodes:
                    raise PackageError("resource-limit", f"more than {self.limits.package_nodes} elements in the package", part)
            except PackageError as e:
                if e.code == "resource-limit":
                    raise PackageError(e.code, str(e), part) from None
                self.report(e.code, "error", part, str(e))
        self._xml[part] = root
        return root

    def relationships(self, part: str) -> list[dict]:
        """rid, type, target, is_external of a part's relationships, in order; unresolvable ones are reported and left out."""
        root = self.xml(ooxml.rels_part(part), required=False)
        out = []
        for x in root.all("Relationship") if root else []:
            kind = x.attrs.get("Type", "")
            kind = next((kind[len(p) :] for p in RELATIONSHIP_TYPES if kind.startswith(p)), kind)
            external = x.attrs.get("TargetMode", "").lower() == "external"
            target = x.attrs.get("Target", "")
            try:
                target = target.strip() if external else ooxml.resolve_target(part, target)
            except ValueError as e:
                self.report("invalid-relationship-target", "warning", ooxml.rels_part(part), str(e))
                continue
            out.append({"owner_part": part, "rid": x.attrs.get("Id", ""), "type": kind, "target": target, "is_external": external})
        return out


def open_package(raw: bytes, limits: Limits = Limits(), strict: bool = False) -> Package:
    """Opens an archive within its limits, before anything is inflated. PackageError: resource-limit or invalid-package."""
    if len(raw) > limits.input_bytes:
        raise PackageError("resource-limit", f"more than {limits.input_bytes} bytes")
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, EOFError, OSError) as e:
        raise PackageError("invalid-package", str(e)) from None
    entries = [i for i in archive.infolist() if not i.is_dir()]
    if len(entries) > limits.entries:
        raise PackageError("resource-limit", f"more than {limits.entries} parts")
    total = 0
    for i in entries:
        total += i.file_size
        if i.file_size > limits.part_bytes:
            raise PackageError("resource-limit", "part too large", i.filename)
        if total > limits.expanded_bytes:
            raise PackageError("resource-limit", "package expands too far")
    return Package(raw, limits, strict, archive, [i.filename for i in entries])
