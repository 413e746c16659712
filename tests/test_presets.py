import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slidelake.functions import presets
from slidelake.functions.geometry import preset_path


def numbers(path):
    return [float(x) for x in re.findall(r"-?[0-9.]+(?:e[+-]?[0-9]+)?", path)]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(presets.OUTLINES)), st.floats(0.01, 5000), st.floats(0.01, 5000), st.dictionaries(st.sampled_from([f"adj{i}" for i in range(1, 9)] + ["adj"]), st.floats(-(10**7), 10**7), max_size=4))
def test_outlines_are_paths(name, w, h, adjust):
    path, exact = preset_path(name, w, h, adjust)
    assert exact and re.fullmatch(r"M( -?[0-9.]+(e[+-]?[0-9]+)?| [MLCQAZ])+", path) and all(math.isfinite(x) for x in numbers(path))


@pytest.mark.parametrize(
    ("name", "w", "h", "path"),
    [
        ("cube", 100, 100, "M 0 25 L 75 25 L 75 100 L 0 100 Z M 0 25 L 25 0 L 100 0 L 75 25 Z M 75 25 L 100 0 L 100 75 L 75 100 Z"),
        ("chartX", 10, 20, "M 0 0 L 10 20 M 0 20 L 10 0"),
        ("pieWedge", 10, 20, "M 0 20 A 10 20 0 0 1 10 0 L 10 20 Z"),
        ("bracketPair", 60, 60, "M 10.0002 60 A 10.0002 10.0002 0 0 1 0 49.9998 L 0 10.0002 A 10.0002 10.0002 0 0 1 10.0002 0 M 49.9998 0 A 10.0002 10.0002 0 0 1 60 10.0002 L 60 49.9998 A 10.0002 10.0002 0 0 1 49.9998 60"),
        ("can", 40, 80, "M 0 5 A 20 5 0 0 0 40 5 L 40 75 A 20 5 0 0 1 0 75 Z M 0 5 A 20 5 0 0 1 40 5 A 20 5 0 0 1 0 5 Z"),
        ("flowChartDelay", 40, 20, "M 0 0 L 20 0 A 20 10 0 0 1 20 20 L 0 20 Z"),
        ("actionButtonBeginning", 16, 16, "M 0 0 L 16 0 L 16 16 L 0 16 Z M 5 8 L 14 2 L 14 14 Z M 3.5 2 L 2 2 L 2 14 L 3.5 14 Z"),
        ("actionButtonForwardNext", 16, 16, "M 0 0 L 16 0 L 16 16 L 0 16 Z M 14 8 L 2 2 L 2 14 Z"),
        ("bentConnector4", 40, 20, "M 0 0 L 20 0 L 20 10 L 40 10 L 40 20"),
        ("curvedConnector3", 40, 20, "M 0 0 C 10 0 20 5 20 10 C 20 15 30 20 40 20"),
        ("borderCallout1", 100, 100, "M 0 0 L 100 0 L 100 100 L 0 100 Z M -8.333 18.75 L -38.333 112.5"),
        ("rightArrowCallout", 100, 100, "M 0 0 L 64.977 0 L 64.977 37.5 L 75 37.5 L 75 25 L 100 50 L 75 75 L 75 62.5 L 64.977 62.5 L 64.977 100 L 0 100 Z"),
        ("downArrowCallout", 100, 100, "M 0 0 L 0 64.977 L 37.5 64.977 L 37.5 75 L 25 75 L 50 100 L 75 75 L 62.5 75 L 62.5 64.977 L 100 64.977 L 100 0 Z"),
    ],
)
def test_outlines(name, w, h, path):
    assert preset_path(name, w, h) == (path, True)


@pytest.mark.parametrize("turn", ["left", "right", "up", "down"])
def test_turned_callouts_fill_their_box(turn):
    xy = numbers(preset_path(f"{turn}ArrowCallout", 120, 60)[0])
    assert (min(xy[::2]), max(xy[::2]), min(xy[1::2]), max(xy[1::2])) == (0, 120, 0, 60)
