"""Cutting texts into pieces that byte-level BPE treats on their own."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Below this, letters are the same in all Unicode versions in use.
LATER = "\u0370"

_ODD = re.compile(r" (?:\s|$)")


def chunks(text: str) -> list[str]:
    """Pieces of text, in order, that no match of the byte-level pattern crosses; they join to text.

    The pattern attaches one space to the run that follows it, so a match always starts at a space whose next character is not white space. Other spaces stay inside their piece.
    """
    if not text:
        return []
    head, *rest = text.split(" ")
    if not _ODD.search(text):
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]
    out = [head]
    for x in rest:
        if not x or x[0].isspace():
            out[-1] += " " + x
        else:
            out.append(" " + x)
    return [x for x in out if x]


#: Stands between pieces.
MARK = "\x01"
#: White space of any script, as Python has it.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def marks(texts: pa.Array, not_in: list[str] = ()) -> pa.Array:
    """The texts with a mark before every space, and around a full stop or comma that ends a word; null for those where that could cut a match, and for those that hold a string of not_in.

    Such a stop is a match of its own where a letter or number stands before it; where one follows anything else, only spaces are marked. The Unicode version here may be younger than the library's, so only texts of older scripts get marks at stops.
    """
    whole = pc.match_substring_regex(texts, f" (?:[{SPACES}]|$)|{MARK}")
    for x in not_in:
        whole = pc.or_(whole, pc.match_substring(texts, x))
    texts = pc.if_else(whole, pa.scalar(None, texts.type), texts)
    odd = pc.match_substring_regex(texts, r"[^\p{L}\p{N}][.,] |[\x{370}-\x{10FFFF}]")
    out = pc.replace_substring(texts, " ", MARK + " ")
    stops = pc.replace_substring(pc.replace_substring(out, "." + MARK, f"{MARK}.{MARK}"), "," + MARK, f"{MARK},{MARK}")
    return pc.if_else(odd, out, stops)


def laid_out(marked: pa.Array, packed: Callable[[list[str]], list[bytes]], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one text after the other, and where each begins and the last ends; a null text has none. Arrow cuts the texts at the marks, numbers the distinct pieces and lays out their ids; `packed` gives the ids of distinct pieces."""
    cut = pc.split_pattern(marked, MARK)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    pieces = cut.flatten().dictionary_encode()
    del cut
    found, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices
    del pieces
    ids = packed(found)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize, out=offsets[1:])
    laid = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype))).take(at)
    return np.ascontiguousarray(laid.values.to_numpy()), laid.offsets.to_numpy()[ends]


def pretokens(piece: str, find) -> list[str]:
    """The matches of the byte-level pattern in a piece. A space and letters are one match, a mark of punctuation behind them another; `find` decides the rest, and whatever holds letters that not every Unicode version has."""
    if piece[0] == " " and (piece.isascii() or max(piece) < LATER):
        if (body := piece[1:]).isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
    return find(piece)


class Memory:
    """A bounded map. When its young half is full it becomes the old half, and what was old is forgotten."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def turn(self) -> dict:
        """The young half, to read and fill, with room in it."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        return self.young


def large_memory() -> None:
    """Rarer collections in this worker: they would walk through the memories again and again, and what these hold has no cycles."""
    gc.set_threshold(1_000_000, 20, 50)
