"""Plain polygons (one ring, closed) as arrays: what is common runs over whole batches, with the results of :mod:`stratum.kernel.shapes`.

Each function returns what it found and leaves the other geometries to the caller, who takes them one by one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

_N = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_WKT = re.compile(rf"\s*POLYGON\s*\(\s*\((\s*{_N}\s+{_N}\s*(?:,\s*{_N}\s+{_N}\s*)*)\)\s*\)\s*", re.ASCII | re.IGNORECASE)
#: Length of the head of a polygon's binary form with one ring.
_HEAD = 13


def wkb_of(text: str) -> bytes | None:
    """Binary form of a polygon with one ring; None for all other texts."""
    m = _WKT.fullmatch(text)
    if not m:
        return None
    v = [*map(float, m[1].replace(",", " ").split())]
    return struct.pack(f"<BIII{len(v)}d", 1, 3, 1, len(v) // 2, *v)


def rings(data: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, coordinates of shape (polygons, corners, 2)) of the plain polygons among binary forms, those with equally many corners together."""
    by_size: dict[int, list[int]] = {}
    for i, b in enumerate(data):
        if b is not None and len(b) >= _HEAD + 64 and not (len(b) - _HEAD) % 16:
            by_size.setdefault(len(b), []).append(i)
    for size, places in by_size.items():
        head = struct.pack("<BIII", 1, 3, 1, (size - _HEAD) // 16)
        raw = np.frombuffer(b"".join([data[i] for i in places]), np.uint8).reshape(-1, size)
        c = np.ascontiguousarray(raw[:, _HEAD:]).view("<f8").reshape(len(raw), -1, 2)
        keep = (raw[:, :_HEAD] == np.frombuffer(head, np.uint8)).all(axis=1) & (c[:, 0] == c[:, -1]).all(axis=1) & np.isfinite(c).all(axis=(1, 2))
        yield np.array(places)[keep], c[keep]


def areas(c: np.ndarray) -> np.ndarray:
    """Shoelace sums with Neumaier's correction, as Python's own sum has it."""
    total, rest = np.zeros(len(c)), np.zeros(len(c))
    x, y = c[..., 0], c[..., 1]
    for i in range(c.shape[1]):
        j = (i + 1) % c.shape[1]
        v = x[:, i] * y[:, j] - x[:, j] * y[:, i]
        t = total + v
        rest += np.where(np.abs(total) >= np.abs(v), (total - t) + v, (v - t) + total)
        total = t
    return np.abs(total + rest) / 2


def texts(c: np.ndarray) -> list[str] | None:
    """Text forms if all coordinates are whole numbers."""
    if not ((c == np.trunc(c)) & (np.abs(c) < 1e15)).all():
        return None
    form = "POLYGON ((" + ", ".join(["%d %d"] * c.shape[1]) + "))"
    return [form % tuple(r) for r in c.reshape(len(c), -1).astype(np.int64).tolist()]


def _side(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _between(a, b, p):
    return (np.minimum(a[0], b[0]) <= p[0]) & (p[0] <= np.maximum(a[0], b[0])) & (np.minimum(a[1], b[1]) <= p[1]) & (p[1] <= np.maximum(a[1], b[1]))


def _holds(ring: list, p) -> np.ndarray:
    """Whether rings, given as their corners, hold points; edges count."""
    inside, on = np.zeros(len(p[0]), bool), np.zeros(len(p[0]), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in zip(ring, ring[1:]):
            on |= (_side(a, b, p) == 0) & _between(a, b, p)
            inside ^= ((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0])
    return inside | on


def _corners(c: np.ndarray) -> list:
    """For each corner its columns x and y."""
    t = np.ascontiguousarray(c.transpose(1, 2, 0))
    return [(x[0], x[1]) for x in t]


def _edges_meet(s: list, t: list) -> np.ndarray:
    met = np.zeros(len(s[0][0]), bool)
    for a, b in zip(s, s[1:]):
        for c, d in zip(t, t[1:]):
            s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
            near = (np.maximum(a[0], b[0]) >= np.minimum(c[0], d[0])) & (np.maximum(c[0], d[0]) >= np.minimum(a[0], b[0])) & (np.maximum(a[1], b[1]) >= np.minimum(c[1], d[1])) & (np.maximum(c[1], d[1]) >= np.minimum(a[1], b[1]))
            cross = ((s1 > 0) != (s2 > 0)) & (s1 != 0) & (s2 != 0) & ((s3 > 0) != (s4 > 0)) & (s3 != 0) & (s4 != 0)
            touch = (s1 == 0) & _between(a, b, c) | (s2 == 0) & _between(a, b, d) | (s3 == 0) & _between(c, d, a) | (s4 == 0) & _between(c, d, b)
            met |= near & (cross | touch)
    return met


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the polygons a[i] and b[i] have a point in common."""
    met = np.zeros(len(a), bool)
    left = np.flatnonzero(((a.max(axis=1) >= b.min(axis=1)) & (b.max(axis=1) >= a.min(axis=1))).all(axis=1))
    # A corner of one in the other decides most pairs; edges are tested for those that are left.
    for first, second in ((a, b), (b, a)):
        found = _holds(_corners(second[left]), (first[left, 0, 0], first[left, 0, 1]))
        met[left[found]] = True
        left = left[~found]
    if len(left):
        met[left] = _edges_meet(_corners(a[left]), _corners(b[left]))
    return met
