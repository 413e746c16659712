"""Colours of the drawing format: six ways to name one, and transforms folded in authored order."""

from __future__ import annotations

import colorsys
import math

from .ooxml import js_round, percentage

# System colours where a file has no last colour, and the preset names (those of CSS).
SYSTEM = {"windowText": "000000", "window": "FFFFFF", "btnFace": "F0F0F0", "highlight": "0078D7", "highlightText": "FFFFFF", "grayText": "6D6D6D"}
_NAMED = """
aliceBlue F0F8FF antiqueWhite FAEBD7 aqua 00FFFF aquamarine 7FFFD4 azure F0FFFF beige F5F5DC bisque FFE4C4 black 000000 blanchedAlmond FFEBCD blue 0000FF blueViolet 8A2BE2 brown A52A2A burlyWood DEB887 cadetBlue 5F9EA0 chartreuse 7FFF00 chocolate D2691E coral FF7F50
cornflowerBlue 6495ED cornsilk FFF8DC crimson DC143C cyan 00FFFF darkBlue 00008B darkCyan 008B8B darkGoldenrod B8860B darkGray A9A9A9 darkGreen 006400 darkKhaki BDB76B darkMagenta 8B008B darkOliveGreen 556B2F darkOrange FF8C00 darkOrchid 9932CC darkRed 8B0000 darkSalmon E9967A
darkSeaGreen 8FBC8F darkSlateBlue 483D8B darkSlateGray 2F4F4F darkTurquoise 00CED1 darkViolet 9400D3 deepPink FF1493 deepSkyBlue 00BFFF dimGray 696969 dodgerBlue 1E90FF firebrick B22222 floralWhite FFFAF0 forestGreen 228B22 fuchsia FF00FF gainsboro DCDCDC ghostWhite F8F8FF
gold FFD700 goldenrod DAA520 gray 808080 green 008000 greenYellow ADFF2F honeydew F0FFF0 hotPink FF69B4 indianRed CD5C5C indigo 4B0082 ivory FFFFF0 khaki F0E68C lavender E6E6FA lavenderBlush FFF0F5 lawnGreen 7CFC00 lemonChiffon FFFACD lightBlue ADD8E6 lightCoral F08080
lightCyan E0FFFF lightGoldenrodYellow FAFAD2 lightGray D3D3D3 lightGreen 90EE90 lightPink FFB6C1 lightSalmon FFA07A lightSeaGreen 20B2AA lightSkyBlue 87CEFA lightSlateGray 778899 lightSteelBlue B0C4DE lightYellow FFFFE0 lime 00FF00 limeGreen 32CD32 linen FAF0E6 magenta FF00FF
maroon 800000 mediumAquamarine 66CDAA mediumBlue 0000CD mediumOrchid BA55D3 mediumPurple 9370DB mediumSeaGreen 3CB371 mediumSlateBlue 7B68EE mediumSpringGreen 00FA9A mediumTurquoise 48D1CC mediumVioletRed C71585 midnightBlue 191970 mintCream F5FFFA mistyRose FFE4E1
moccasin FFE4B5 navajoWhite FFDEAD navy 000080 oldLace FDF5E6 olive 808000 oliveDrab 6B8E23 orange FFA500 orangeRed FF4500 orchid DA70D6 paleGoldenrod EEE8AA paleGreen 98FB98 paleTurquoise AFEEEE paleVioletRed DB7093 papayaWhip FFEFD5 peachPuff FFDAB9 peru CD853F pink FFC0CB
plum DDA0DD powderBlue B0E0E6 purple 800080 red FF0000 rosyBrown BC8F8F royalBlue 4169E1 saddleBrown 8B4513 salmon FA8072 sandyBrown F4A460 seaGreen 2E8B57 seaShell FFF5EE sienna A0522D silver C0C0C0 skyBlue 87CEEB slateBlue 6A5ACD slateGray 708090 snow FFFAFA springGreen 00FF7F
steelBlue 4682B4 tan D2B48C teal 008080 thistle D8BFD8 tomato FF6347 turquoise 40E0D0 violet EE82EE wheat F5DEB3 white FFFFFF whiteSmoke F5F5F5 yellow FFFF00 yellowGreen 9ACD32
""".split()
PRESETS = dict(zip(_NAMED[::2], _NAMED[1::2], strict=True))
SHORT = {"dark": "dk", "light": "lt", "medium": "med"}  # names that begin so have a short form too
# End of fixed values.

PRESETS |= {short + n[len(long) :]: c for long, short in SHORT.items() for n, c in PRESETS.items() if n.startswith(long)}
PRESETS |= {n.replace("Gray", "Grey").replace("gray", "grey"): c for n, c in PRESETS.items() if "gray" in n.lower()}


def _bytes(rgb: tuple[float, float, float]) -> str:
    return "".join(f"{max(0, min(255, int(js_round(c * 255)))):02X}" for c in rgb)


def _rgb(hex6: str) -> tuple[float, float, float]:
    return tuple(int(hex6[i : i + 2], 16) / 255 for i in (0, 2, 4))  # type: ignore[return-value]


def in_hsl(hex6: str, h: float | None = None, s=lambda x: x, light=lambda x: x) -> str:
    """The colour with hue shifted and saturation and luminance changed, each clamped; back to 8-bit channels."""
    hh, ll, ss = colorsys.rgb_to_hls(*_rgb(hex6))
    hh = (hh + (h or 0)) % 1
    clamp = lambda x: max(0.0, min(1.0, x))
    return _bytes(colorsys.hls_to_rgb(hh, clamp(light(ll)), clamp(s(ss))))


def transformed(hex6: str, steps: list[tuple[str, float]]) -> str:
    """`#RRGGBB`, with AA if it isn't opaque, after the steps in order. Each step works on the 8-bit result of the one before."""
    alpha = 1.0
    for kind, v in steps:
        if kind == "alpha":
            alpha = v
        elif kind == "alphaMod":
            alpha *= v
        elif kind == "alphaOff":
            alpha += v
        elif kind == "hueMod":
            h, ll, s = colorsys.rgb_to_hls(*_rgb(hex6))
            hex6 = _bytes(colorsys.hls_to_rgb((h * v) % 1, ll, s))
        elif kind == "lumMod":
            hex6 = in_hsl(hex6, light=lambda x, v=v: x * v)
        elif kind == "lumOff":
            hex6 = in_hsl(hex6, light=lambda x, v=v: x + v)
        elif kind == "satMod":
            hex6 = in_hsl(hex6, s=lambda x, v=v: x * v)
        elif kind == "shade":
            hex6 = in_hsl(hex6, light=lambda x, v=v: x * v)
        elif kind == "tint":
            hex6 = in_hsl(hex6, light=lambda x, v=v: x * v + (1 - v))
    alpha = max(0.0, min(1.0, alpha))
    return f"#{hex6}" + (f"{int(js_round(alpha * 255)):02X}" if alpha < 1 else "")


def degrees_of(text: str | None) -> float | None:
    """The degrees of a stored angle; None if it isn't a finite number."""
    try:
        x = float(text or "")
    except ValueError:
        return None
    return x / 60000 if math.isfinite(x) else None


def resolved(kind: str, value: dict[str, str], scheme: dict[str, str], color_map: dict[str, str], placeholder: str | None = None) -> str | None:
    """Six hexadecimal digits of a colour element (its local name and attributes); None if it names nothing known."""
    v = value.get("val", "")
    if kind == "srgbClr":
        return v if len(v) == 6 and all(c in "0123456789abcdefABCDEF" for c in v) else None
    if kind == "schemeClr":
        if v == "phClr":
            return placeholder
        return scheme.get(color_map.get(v, v) if v in ("tx1", "tx2", "bg1", "bg2") else v)
    if kind == "scrgbClr":
        parts = [percentage(value.get(c)) for c in "rgb"]
        return None if None in parts else _bytes(tuple(parts))  # type: ignore[arg-type]
    if kind == "prstClr":
        return PRESETS.get(v)
    if kind == "hslClr":
        h, s, ll = degrees_of(value.get("hue")), percentage(value.get("sat")), percentage(value.get("lum"))
        return None if s is None or ll is None or h is None else _bytes(colorsys.hls_to_rgb(h / 360 % 1, ll, s))
    if kind == "sysClr":
        return value.get("lastClr") or SYSTEM.get(v)
    return None
