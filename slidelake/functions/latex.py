"""Office Math to LaTeX."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from slidelake.sources.package import Node

# What each structure becomes, <x> standing for its part x; names of accents; characters that stand for themselves where a file names none.
STRUCTURES = {
    "f": "\\frac{<num>}{<den>}", "sSup": "<e>^{<sup>}", "sSub": "<e>_{<sub>}", "sSubSup": "<e>_{<sub>}^{<sup>}", "nary": "<chr>_{<sub>}^{<sup>}{<e>}", "limLow": "<e>_{<lim>}", "limUpp": "<e>^{<lim>}", "func": "\\<fName>{<e>}",
    "groupChr": "<chr><e><chr>", "borderBox": "\\boxed{<e>}", "acc": "\\<accent>{<e>}", "m": "\\begin{matrix} <rows> \\end{matrix}", "eqArr": "\\begin{cases} <lines> \\end{cases}", "rad": "\\sqrt<degree>{<e>}", "bar": "\\<line>{<e>}", "d": "<open><e><close>",
}
ACCENTS = {"\u0300": "grave", "\u0301": "acute", "\u0302": "hat", "\u0303": "tilde", "\u0304": "bar", "\u0306": "breve", "\u0307": "dot", "\u0308": "ddot", "\u030a": "mathring", "\u030b": "H", "\u030c": "check", "\u0327": "c"}
DEFAULTS = {"nary": "∫", "acc": "^", "groupChr": ""}
# End of fixed values.


def latex(node: Node) -> str:
    """The formula under an m: element, in document order; elements that are no structure give what they hold, properties nothing."""
    name = node.tag.rpartition(":")[2]
    if name == "t":
        return node.text or ""
    if name not in STRUCTURES:
        return "" if name.endswith("Pr") else "".join(map(latex, node.children))
    return re.sub("<([A-Za-z]+)>", lambda m: _part(node, name, m[1]), STRUCTURES[name])


def _part(node: Node, name: str, part: str) -> str:
    held = lambda of, tag: "".join(latex(c) for x in of.all(f"m:{tag}") for c in x.children)
    given = lambda tag: node.get(f"m:{name}Pr", f"m:{tag}", "m:val")
    each = lambda of, tag: ["".join(map(latex, x.children)) for x in of.all(f"m:{tag}")]
    if part == "chr":
        return given("chr") if given("chr") is not None else DEFAULTS[name]
    if part == "accent":
        c = given("chr") if given("chr") is not None else DEFAULTS[name]
        return ACCENTS.get(c, c)
    if part == "degree":
        return f"[{d}]" if (d := held(node, "deg")) else ""
    if part == "line":
        return "overline" if given("pos") == "top" else "underline"
    if part == "rows":
        return " \\\\ ".join(" & ".join(each(r, "e")) for r in node.all("m:mr"))
    if part == "lines":
        return " \\\\ ".join(each(node, "e"))
    if part in ("open", "close"):
        left, right = given("begChr"), given("endChr")
        if not left and not right:
            left, right = "(", ")"
        own = left if part == "open" else right
        return {"open": "\\left", "close": "\\right"}[part] + own if left and right else own or ""
    return held(node, part)
