"""Scalar functions of the presentation format: units, numbers, text escapes, part names, media types, digests.

Each plain function is the definition; where Spark's own functions can say the same, a Column version stands beside it, so queries stay in the JVM.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from html import unescape
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
EMU_PER_INCH, POINTS_PER_INCH, EMU_PER_POINT = 914400, 72, 12700
ANGLE_UNITS, FONT_UNITS = 60000, 100
SAFE_INTEGER = 2**53 - 1
MEDIA_TYPES = {
    "bmp": "image/bmp", "emf": "image/x-emf", "gif": "image/gif", "jpe": "image/jpeg", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "wmf": "image/x-wmf",
    "m4a": "audio/mp4", "mp3": "audio/mpeg", "mp4": "video/mp4", "ogg": "video/ogg", "wav": "audio/wav", "webm": "video/webm",
}
# End of fixed values.

LINK_SCHEMES = ("http", "https", "mailto")


def js_round(x: float) -> float:
    """Halves go up, also below zero."""
    return math.floor(x + 0.5)


def js_round_col(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def to_fixed(x: float, places: int = 4) -> float:
    """x at so many decimals by its exact binary value, halves away from zero; infinite and NaN values pass."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if math.isfinite(x) else x


def emu_to_points(emu: float) -> float:
    return to_fixed(emu * POINTS_PER_INCH / EMU_PER_INCH)


def emu_to_points_col(emu: Column) -> Column:
    """For whole EMU the rounding can't meet a tie."""
    return F.round(emu * F.lit(float(POINTS_PER_INCH)) / F.lit(float(EMU_PER_INCH)), 4)


def units(x: float, per: float, positive: bool = False) -> int:
    """x in whole format units. ValueError if that is not a safe integer, or not above 0 where it must be."""
    n = js_round(x * per) if math.isfinite(x) else math.inf
    if abs(n) > SAFE_INTEGER or positive and n <= 0:
        raise ValueError(f"{x} can't be stored")
    return int(n)


def points_to_emu(x: float) -> int:
    return units(x, EMU_PER_POINT)


def degrees(angle: float) -> int:
    """Whole degrees of a stored angle."""
    return int(js_round(angle / ANGLE_UNITS))


def percentage(text: str | None) -> float | None:
    """`n%` or thousandths of a percent, as a ratio."""
    if not text:
        return None
    try:
        x = float(text[:-1]) / 100 if text.endswith("%") else float(text) / 100000
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def js_number(x: float) -> str:
    """A number as JavaScript prints it: shortest digits, no trailing `.0`, exponents from 1e21 and below 1e-6, no negative zero."""
    if x == 0:
        return "0"
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    sign, digits, exp = Decimal(repr(float(x))).as_tuple()
    d = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exp
    if -6 < point <= 21:
        s = d.ljust(point, "0") if len(d) <= point else f"{d[:point]}.{d[point:]}" if point > 0 else f"0.{'0' * -point}{d}"
    else:
        e = point - 1
        s = f"{d[0]}{'.' + d[1:] if len(d) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if sign else "") + s


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_length_col(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16LE")) / 2


# Text.

_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9A-Fa-f]+)|(amp|lt|gt|quot|apos));", re.IGNORECASE)
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_OFFICE, _SURROGATE = re.compile(r"_x([0-9A-Fa-f]{4})_"), re.compile("[\ud800-\udfff]")


def decode_entities(text: str) -> str:
    """The five named and numeric entities, once; numbers beyond Unicode stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3].lower()]
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def decode_office(text: str) -> str:
    """`_xHHHH_` stands for a UTF-16 unit; units that pair make one character."""
    if "_x" not in text:
        return text
    out = _OFFICE.sub(lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if _SURROGATE.search(out) else out


def escape_office(text: str) -> str:
    """Text that looks like such an escape is kept as text."""
    return re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)


def escape_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")


def escape_html_col(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_BAD_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def xml_safe(text: str) -> bool:
    return not _BAD_XML.search(text)


def xml_filtered(text: str) -> str:
    """Code points that XML can't hold become U+FFFD."""
    return _BAD_XML.sub("\ufffd", text)


def escape_xml(text: str) -> str:
    return escape_office(text).replace("\r", "_x000D_").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_xml_attribute(text: str) -> str:
    return escape_xml(text).replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")


def needs_preserve(text: str) -> bool:
    """Whether xml:space="preserve" is needed."""
    return bool(re.search(r"^\s|\s$|  |[\t\r\n]", text))


_TAG = re.compile(r"<[^>]*>")


def plain_preview(html: str) -> str:
    """Text of an HTML body as the editor shows it: breaks, paragraph and item ends are newlines; trailing newlines go."""
    return unescape(_TAG.sub("", re.sub(r"<br\s*/?>|</p>|</li>", "\n", html, flags=re.IGNORECASE))).replace("\xa0", " ").rstrip("\n")


def plain_render(html: str) -> str:
    """Text of an HTML body as the renderer lays it out: one newline a block, bullets, trimmed lines, no more than two newlines together."""
    t = re.sub(r"<li\b[^>]*>(?:\s*<p\b[^>]*>)?", "\n• ", html, flags=re.IGNORECASE)
    t = re.sub(r"<br\s*/?>|</?(?:p|div|ul|ol|h\d|tr|table)\b[^>]*>|</li>", "\n", t, flags=re.IGNORECASE)
    t = unescape(_TAG.sub("", t)).replace("\xa0", " ")
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


_RUN_STYLE = {"color": r"#[0-9a-fA-F]{6}", "font-size": r"[0-9]+(?:\.[0-9]+)?pt", "font-family": r"""(["']?)[\w ._-]{1,80}\1"""}


def _declared(attributes: str) -> dict[str, str]:
    """The declarations of a tag's style."""
    m = re.search(r"""(?:^|\s)style\s*=\s*(?:"([^"]*)"|'([^']*)')""", attributes, re.IGNORECASE)
    pairs = (d.partition(":") for d in decode_entities((m[1] if m[1] is not None else m[2]) if m else "").split(";"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs if v.strip()}


def html_paragraphs(html: str) -> list[dict]:
    """Paragraphs of an HTML body with alignment (left, center, right) and runs of text, bold, italic, color, fontFamily and fontSize, as the renderer lays them out; paragraphs without text are left out, text outside of paragraphs and spans is a run of its own."""
    inline = lambda t: decode_entities(re.sub(r"&nbsp;", "\xa0", re.sub(r"<(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>", lambda m: "\n" if re.match(r"<\s*br\b", m[0], re.IGNORECASE) else "", t), flags=re.IGNORECASE)).replace("\r\n", "\n").replace("\r", "\n")

    def run(attributes: str, inner: str) -> dict:
        css = _declared(attributes)
        good = {k: css[k] for k, p in _RUN_STYLE.items() if k in css and re.fullmatch(p, css[k])}
        out = {"text": inline(inner), "bold": bool(re.fullmatch(r"[6-9]00|bold", css.get("font-weight", ""), re.IGNORECASE)), "italic": css.get("font-style", "").lower() == "italic"}
        out |= {"color": good["color"]} if "color" in good else {}
        out |= {"fontFamily": good["font-family"].strip("\"'")} if "font-family" in good else {}
        size = float(good["font-size"][:-2]) if "font-size" in good else 0
        return out | ({"fontSize": size} if 0 < size <= 512 else {})

    plain = lambda t: [{"text": t, "bold": False, "italic": False}] if t else []
    out = []
    for m in re.finditer(r"<(p|li)\b([^>]*)>(.*?)</\1\s*>", html, re.IGNORECASE | re.DOTALL):
        runs = [r for s in re.finditer(r"<span\b([^>]*)>(.*?)</span\s*>", m[3], re.IGNORECASE | re.DOTALL) if (r := run(s[1], s[2]))["text"]] or plain(plain_render(m[3]))
        align = _declared(m[2]).get("text-align")
        if runs:
            out.append({"alignment": align if align in ("center", "right") else "left", "runs": runs})
    return out or [{"alignment": "left", "runs": r} for r in [plain(plain_render(html))] if r]


def has_visible_text(html: str) -> bool:
    return bool(plain_preview(html).strip())


def sanitize_link(url: str | None) -> str | None:
    """The trimmed URL if it is absolute with an allowed scheme, else None."""
    u = (url or "").strip()
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)$", u, re.DOTALL)
    if not m or m[1].lower() not in LINK_SCHEMES:
        return None
    if m[1].lower() == "mailto":
        return u
    try:
        return u if urlsplit(u if m[2].startswith("//") else f"{m[1]}://{m[2].lstrip('/')}").hostname else None
    except ValueError:
        return None


def sanitize_link_col(url: Column) -> Column:
    u = F.trim(url)
    ok = F.lower(u).rlike(r"^https?:/*[^/?#\s]+") | F.lower(u).rlike(r"^mailto:")
    return F.when(ok, u)


def hex_color(text: str | None) -> str | None:
    """`#` and 6 or 8 hexadecimal digits, as given; None for anything else."""
    return text if text and re.fullmatch(r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})", text) else None


def css_family(name: str) -> str:
    """A font family as a CSS string."""
    return "'" + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\{ord(m[0]):x} ", name.replace("\\", "\\\\").replace("'", "\\'")) + "'"


def column_name(n: int) -> str:
    """The spreadsheet name of the n-th column, from 1."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_name_col(n: Column) -> Column:
    """The same, for any positive column: those with k letters begin at 1 + 26 + ... + 26^(k - 1)."""
    div = lambda x, by: F.call_function("div", x, F.lit(by))
    first = [sum(26**i for i in range(k)) for k in range(15)]
    names = [F.concat(*(F.char(F.lit(65) + div(n - first[k], 26**i) % 26) for i in reversed(range(k)))) for k in range(1, 15)]
    out = F.when(n < 1, "")
    for k, name in enumerate(names[:-1], 1):
        out = out.when(n < first[k + 1], name)
    return out.when(n.isNotNull(), names[-1])


# Part names.


def rels_part(part: str) -> str:
    """The relationship part of a part."""
    folder, _, name = part.rpartition("/")
    return f"{folder + '/' if folder else ''}_rels/{name}.rels"


def rels_part_col(part: Column) -> Column:
    return F.regexp_replace(part, r"^(.*/)?([^/]*)$", r"$1_rels/$2.rels")


def resolve_target(owner: str, target: str) -> str:
    """The part that a relationship of `owner` names. ValueError: a scheme, or dot segments that leave the package."""
    t = re.split(r"[?#]", target.strip(), maxsplit=1)[0].replace("\\", "/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", t):
        raise ValueError(f"not a part: {target}")
    path = [] if t.startswith("/") else owner.split("/")[:-1]
    for x in t.split("/"):
        if x == "..":
            if not path:
                raise ValueError(f"leaves the package: {target}")
            path.pop()
        elif x not in ("", "."):
            path.append(x)
    return "/".join(path)


def resolve_target_col(owner: Column, target: Column) -> Column:
    """The same with a fold over path segments; null where the plain function raises."""
    t = F.replace(F.regexp_replace(F.trim(target), r"[?#].*$", ""), F.lit("\\"), F.lit("/"))
    base = F.when(t.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(owner, "/"), F.lit(1), F.size(F.split(owner, "/")) - 1))
    bad = F.array(F.lit("\0"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.get(acc, F.lit(0)) == "\0", acc).when(x == "..", F.when(F.size(acc) == 0, bad).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))

    path = F.aggregate(F.split(t, "/"), base, step)
    return F.when(target.isNull() | t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (F.get(path, F.lit(0)) == "\0"), None).otherwise(F.concat_ws("/", path))


def extension(name: str) -> str:
    base = re.split(r"[?#]", name, maxsplit=1)[0]
    return base.rpartition(".")[2].lower() if "." in base else ""


def media_type(name: str) -> str:
    return MEDIA_TYPES.get(extension(name), "application/octet-stream")


def media_type_col(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.regexp_replace(name, r"[?#].*$", ""), r"\.([^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.get(F.array(F.element_at(table, ext)), F.lit(0)), F.lit("application/octet-stream"))


def data_url_col(mime: Column, data: Column) -> Column:
    """base64() breaks lines by default; data URLs have none."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\r\n", ""))


def strict_base64(text: str) -> bytes:
    """Decodes canonical base64 only: no other characters, right padding, padding bits 0. ValueError else."""
    try:
        raw = base64.b64decode(text, validate=True)
    except binascii.Error as e:
        raise ValueError(str(e)) from None
    if base64.b64encode(raw).decode() != text:
        raise ValueError("not canonical base64")
    return raw


# Digests.


def canonical_json(value: object, depth: int = 64) -> str:
    """JSON with keys in UTF-16 order and numbers as JavaScript prints them. ValueError: not finite, too deep or no JSON value."""
    if depth < 0:
        raise ValueError("too deep")
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return js_number(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical_json(x, depth - 1) for x in value) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k], depth - 1)}" for k in keys) + "}"
    raise ValueError(f"no JSON value: {type(value).__name__}")


def canonical_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def scaled_grid(sizes: list[int], total: int) -> list[int]:
    """Sizes in proportion that sum to total: rounded shares of at least 1, the last takes the rest. ValueError: total has less than 1 each."""
    if total < len(sizes) or not sizes:
        raise ValueError("no room")
    whole, out, left = sum(sizes), [], total
    for i, s in enumerate(sizes[:-1]):
        rest = len(sizes) - 1 - i
        share = max(1, min(left - rest, int(js_round(s * total / whole)) if whole else total // len(sizes)))
        out.append(share)
        left -= share
    return [*out, left]
