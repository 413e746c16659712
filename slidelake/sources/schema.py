"""The tables that a deck becomes. Every list has its own ordinal; recursive groups are rows with a path."""

from __future__ import annotations

from collections.abc import Iterable

_BOX = "left double, top double, width double, height double"
TABLES: dict[str, str] = {
    "parts": "part string, ext string, mime string, byte_length bigint, sha256 string",
    "relationships": "owner_part string, rid string, type string, target string, is_external boolean",
    "xml_nodes": "part string, node_id int, parent_id int, ord int, depth int, tag string, attrs map<string,string>, text string",
    "slides": "slide_no int, part string, layout_part string, master_part string, theme_part string, notes_part string, note_html string, background string, transition_type string, transition_ms bigint, transition_direction string, auto_next_after bigint, hidden boolean",
    "elements": f"slide_no int, origin string, tree_path array<int>, key string, type string, id string, name string, ord int, {_BOX}, rotate double, flip_h boolean, flip_v boolean, fill_type string, fill_color string, border_color string, border_width double, border_type string, border_dash string, head_end string, tail_end string, pattern string, pattern_back string, gradient_angle double, gradient_path string, fill_media string, fill_opacity double, saturation double, brightness double, contrast double, sharpen double, soften double, color_temperature double, opacity double, shadow_h double, shadow_v double, shadow_blur double, shadow_color string, content string, plain_text string, v_align string, auto_fit string, font_scale double, inset_l double, inset_t double, inset_r double, inset_b double, is_vertical boolean, link string, shape_type string, svg_path string, stroke_only boolean, keypoints map<string,double>, media_part string, media_mode string, crop_t double, crop_b double, crop_l double, crop_r double, latex string, chart_type string, bar_dir string, grouping string, hole_size double, marker boolean",
    "runs": "slide_no int, key string, row_no int, col_no int, para_no int, run_no int, kind string, text string, face string, size double, color string, bold boolean, italic boolean, underline boolean, strike boolean, baseline string, spacing double, shadow string, link string, align string, list_type string, list_level int, line_height double, space_before double, space_after double, indent double, margin_left double",
    "table_cells": "slide_no int, key string, row_no int, col_no int, text string, row_span int, col_span int, v_merge boolean, h_merge boolean, fill_color string, font_color string, font_bold boolean, v_align string, width double, height double, border_top string, border_bottom string, border_left string, border_right string",
    "chart_points": "slide_no int, key string, series_no int, series_name string, series_color string, idx int, category string, y double",
    "chart_xy": "slide_no int, key string, row_no int, idx int, v double",
    "gradient_stops": "slide_no int, key string, stop_no int, pos double, color string",
    "diagram_text": "slide_no int, key string, n int, text string",
    "media": "part string, mime string, bytes binary",
    "diagnostics": "seq int, code string, severity string, part string, message string",
}
DECK = "width double, height double, theme_colors array<string>, used_fonts array<string>, conformance string, part_count int"


def deck_row(tables: Iterable[str] = tuple(TABLES), columns: Iterable[str] | None = None) -> str:
    """The columns of a deck's row: what became of it, its own columns, and its tables as arrays, with all their columns or those that are named."""
    named = None if columns is None else set(columns)
    arrays = (f"{t} array<struct<{', '.join(f'`{c.split()[0]}`: {c.split(None, 1)[1]}' for c in TABLES[t].split(', ') if named is None or c.split()[0] in named)}>>" for t in tables)
    return ", ".join(("deck_id string, path string, byte_length bigint, status string, code string, message string", DECK, *arrays))
