"""Parsing of sizes, colours and dates, and colour gradients."""

from __future__ import annotations

import colorsys
import re
from datetime import date, timedelta

#: Units of sizes, and colour names.
UNITS = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}
COLOURS = {
    "red": (255, 0, 0, 255), "pink": (255, 175, 175, 255), "blue": (0, 0, 255, 255), "cyan": (0, 255, 255, 255), "green": (0, 255, 0, 255),
    "black": (0, 0, 0, 255), "white": (255, 255, 255, 255), "gray": (128, 128, 128, 255), "orange": (255, 200, 0, 255), "yellow": (255, 255, 0, 255), "none": (0, 0, 0, 0),
}


def parse_size(text: str) -> int:
    """Bytes: 10.mb, 1.5gb, 2048."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\.?\s*([kmgt]?b?)\s*", text.lower())
    if not m or (m[2] not in UNITS and f"{m[2]}b" not in UNITS):
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS.get(m[2], UNITS.get(f"{m[2]}b", 1)))


def parse_colour(text: str) -> tuple[int, int, int, int]:
    """A name, #rrggbb or #rrggbbaa."""
    if text.lower() in COLOURS:
        return COLOURS[text.lower()]
    m = re.fullmatch(r"#([0-9a-fA-F]{6})([0-9a-fA-F]{2})?", text)
    if not m:
        raise ValueError(f"not a colour: {text!r}")
    return *bytes.fromhex(m[1]), int(m[2] or "ff", 16)


def parse_day(text: str) -> date:
    """yyyy.MM.dd, yyyy-MM-dd; a missing day or month is the first. Days have no zone."""
    parts = [int(p) for p in re.split(r"[.\-/]", text.strip())]
    return date(*(parts + [1, 1])[:3])


def parse_days(text: str) -> tuple[date, date]:
    """[first, end): a..b excludes day b; a single day, month or year is that period."""
    if ".." in text:
        a, b = text.split("..")
        return parse_day(a), parse_day(b)
    first, n = parse_day(text), len(re.split(r"[.\-/]", text.strip()))
    if n == 1:
        return first, date(first.year + 1, 1, 1)
    if n == 2:
        return first, date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return first, first + timedelta(days=1)


def gradient(value: float, low: float, high: float, first: tuple, last: tuple, space: str = "hsb") -> tuple[int, int, int, int]:
    """The colour of a value between two colours, clamped to them."""
    t = 0.0 if high == low else min(1.0, max(0.0, (value - low) / (high - low)))
    mix = lambda a, b: a + (b - a) * t
    if space == "rgb":
        return tuple(round(mix(a, b)) for a, b in zip(first, last))
    a, b = (colorsys.rgb_to_hsv(*(c / 255 for c in x[:3])) for x in (first, last))
    return *(round(255 * c) for c in colorsys.hsv_to_rgb(*map(mix, a, b))), round(mix(first[3], last[3]))
