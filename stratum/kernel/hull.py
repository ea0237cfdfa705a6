"""Skyline, hull and extreme pairs of point arrays."""

from __future__ import annotations

import numpy as np


def skyline(pts: np.ndarray) -> np.ndarray:
    """Points that no other one exceeds or equals in both coordinates, without repeats, from the greatest x down."""
    if not len(pts):
        return pts
    pts = pts[np.lexsort((-pts[:, 1], -pts[:, 0]))]
    ahead = np.concatenate([[-np.inf], np.maximum.accumulate(pts[:, 1])[:-1]])
    return pts[pts[:, 1] > ahead]


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(pts: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise from the least (x, y)."""
    pts = np.unique(pts, axis=0)
    if len(pts) <= 2:
        return pts
    p = pts.tolist()

    def chain(points):
        out = []
        for q in points:
            while len(out) > 1 and _turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = chain(p), chain(reversed(p))
    return np.array(lower[:-1] + upper[:-1])


def farthest(pts: np.ndarray) -> tuple | None:
    """(x1, y1, x2, y2, distance) among few points."""
    if len(pts) < 2:
        return None
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]
    best = None
    for i in range(len(pts) - 1):
        d = ((pts[i + 1 :] - pts[i]) ** 2).sum(axis=1)
        j = int(d.argmax())
        if best is None or d[j] > best[0]:
            best = (d[j], i, i + 1 + j)
    _, i, j = best
    return (*pts[i].tolist(), *pts[j].tolist(), float(np.sqrt(best[0])))


def closest_distance(pts: np.ndarray) -> float | None:
    """Least distance of two of the points, by a sweep along x."""
    if len(pts) < 2:
        return None
    pts = pts[np.argsort(pts[:, 0], kind="stable")]
    best = np.inf
    for i in range(len(pts) - 1):
        k = i + 1 + int(np.searchsorted(pts[i + 1 :, 0], pts[i, 0] + best, side="right"))
        if k > i + 1:
            best = min(best, float(np.sqrt(((pts[i + 1 : k] - pts[i]) ** 2).sum(axis=1).min())))
    return best
