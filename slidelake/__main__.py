"""python -m slidelake [COMMAND] INPUT: one package at a time, without Spark. INPUT may be - for standard input, with --format.

convert INPUT [-o FILE]                        the deck's tables as JSON (the command may be left out)
render INPUT -o FOLDER                         an SVG for each slide and manifest.json
snapshot INPUT [-o FILE]                       a snapshot as JSON
edit-text INPUT --target KEY --value TEXT      a snapshot with a run's text replaced
transform-text INPUT --target KEY --x N ..     a snapshot with an element's transform changed
restore INPUT -o FILE                          the package of a snapshot

Exit 0: done; 1: the input can't be done, with one line of JSON on stderr; 2: wrong use.
"""

from __future__ import annotations

import argparse
import base64
import json
import sys
from pathlib import Path

from slidelake import __version__
from slidelake.operators import render, roundtrip
from slidelake.sources.deck import Options, parse_deck
from slidelake.sources.package import PackageError
from slidelake.sources.schema import TABLES

COMMANDS = ("convert", "render", "snapshot", "edit-text", "transform-text", "restore")
NUMBERS = {"x": "x", "y": "y", "width": "width", "height": "height", "rotation": "rotation"}
FLIPS = {"flip-horizontal": "flipHorizontal", "flip-vertical": "flipVertical"}


def _bytes(a: argparse.Namespace) -> bytes:
    return sys.stdin.buffer.read() if a.input == "-" else Path(a.input).read_bytes()


def _text(a: argparse.Namespace) -> str:
    return _bytes(a).decode("utf-8")


def _put(a: argparse.Namespace, text: str) -> None:
    if a.output:
        Path(a.output).write_text(text, "utf-8")
    else:
        print(text)


def error_line(error: Exception) -> str:
    return json.dumps({"error": {"code": getattr(error, "code", "failed"), "message": str(error)}}, ensure_ascii=False)


def _convert(a: argparse.Namespace) -> None:
    row = parse_deck(_bytes(a), "" if a.input == "-" else a.input, Options(strict=a.strict, xml=a.xml, media=a.image_mode == "base64"))
    if row["status"] != "ok":
        raise PackageError(row["code"], row["message"])
    for m in row.get("media", []):
        m["bytes"] = f"data:{m['mime']};base64,{base64.b64encode(m['bytes']).decode()}"
    if a.document_only:
        row = {k: v for k, v in row.items() if k in TABLES and k != "diagnostics" or k in ("width", "height", "theme_colors", "used_fonts")}
    _put(a, json.dumps(row, ensure_ascii=False, default=str, indent=2 if a.pretty else None))


def _render(a: argparse.Namespace) -> None:
    slides = tuple(map(int, a.slides.split(","))) if a.slides else None
    out, manifest = Path(a.output), []
    out.mkdir(parents=True, exist_ok=True)
    for s in render.render_deck(_bytes(a), render.Request(slides, a.scale)):
        data = s["data"].encode("utf-8")
        (out / f"slide-{s['slide_no']}.svg").write_bytes(data)
        manifest.append({"file": f"slide-{s['slide_no']}.svg", "bytes": len(data), "mime": s["mime"], "width": s["width"], "height": s["height"], "warnings": s["warnings"]})
    (out / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=False, indent=1), "utf-8")


def _portable(a: argparse.Namespace, snapshot: dict) -> None:
    text = roundtrip.to_json(snapshot)
    _put(a, json.dumps(json.loads(text), ensure_ascii=False, indent=2) if a.pretty else text)


def _snapshot(a: argparse.Namespace) -> None:
    _portable(a, roundtrip.read_snapshot(_bytes(a)))


def _edit(a: argparse.Namespace) -> None:
    s = roundtrip.from_json(_text(a))
    if a.command == "edit-text":
        _portable(a, roundtrip.replace_text(s, a.target, a.value))
        return
    value = {name: getattr(a, option.replace("-", "_")) for option, name in (NUMBERS | FLIPS).items()}
    _portable(a, roundtrip.set_transform(s, a.target, {k: v for k, v in value.items() if v is not None}))


def _restore(a: argparse.Namespace) -> None:
    Path(a.output).write_bytes(roundtrip.restore(roundtrip.from_json(_text(a))))


def _truth(text: str) -> bool:
    if text not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text == "true"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="slidelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    parser.add_argument("-v", "--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in zip(COMMANDS, (_convert, _render, _snapshot, _edit, _edit, _restore), strict=True):
        p = commands.add_parser(name, allow_abbrev=False)
        p.add_argument("input")
        p.add_argument("-o", "--output", required=name in ("render", "restore"))
        p.add_argument("--format", choices=["pptx"])
        if name not in ("render", "restore"):
            p.add_argument("--pretty", action="store_true")
        if name == "convert":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--xml", action="store_true")
            p.add_argument("--document-only", action="store_true")
            p.add_argument("--image-mode", choices=["none", "base64"], default="none")
        if name == "render":
            p.add_argument("--render-format", choices=["svg"], default="svg")
            p.add_argument("--slides")
            p.add_argument("--scale", type=float, default=1.0)
        if name in ("edit-text", "transform-text"):
            p.add_argument("--target", required=True)
        if name == "edit-text":
            p.add_argument("--value", required=True)
        if name == "transform-text":
            for x in NUMBERS:
                p.add_argument(f"--{x}", type=float)
            for x in FLIPS:
                p.add_argument(f"--{x}", type=_truth)
        p.set_defaults(run=run)
    return parser


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in (*COMMANDS, "-h", "--help", "-v", "--version"):
        argv.insert(0, "convert")
    parser = _parser()
    a = parser.parse_args(argv)
    if a.input == "-" and not a.format and a.command in ("convert", "render", "snapshot"):
        parser.error("standard input needs --format")
    if a.output and a.input != "-" and Path(a.output).resolve() == Path(a.input).resolve():
        parser.error("output and input are the same file")
    try:
        a.run(a)
    except (PackageError, ValueError, OSError) as e:
        print(error_line(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
