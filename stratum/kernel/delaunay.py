"""Delaunay triangulation by insertion, with exact predicates.

Triangles beyond the hull have a ghost corner (-1), so no large auxiliary triangle distorts anything. Predicates are
computed in doubles and, where rounding could matter, anew in rationals. Of cocircular points either
diagonal may appear.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1


def orient(a, b, c) -> int:
    """1 if a, b, c turn left, -1 right, 0 on a line."""
    l, r = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = l - r
    if abs(det) > 1e-14 * (abs(l) + abs(r)):
        return 1 if det > 0 else -1
    f = Fraction
    det = (f(b[0]) - f(a[0])) * (f(c[1]) - f(a[1])) - (f(b[1]) - f(a[1])) * (f(c[0]) - f(a[0]))
    return (det > 0) - (det < 0)


def in_circle(a, b, c, d) -> int:
    """1 if d is within the circle through a, b, c (counter-clockwise), 0 on it."""

    def det(k):
        ax, ay, bx, by, cx, cy = (k(p[i]) - k(d[i]) for p in (a, b, c) for i in (0, 1))
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        terms = (ax * by * cc, bx * cy * aa, cx * ay * bb, -ax * cy * bb, -bx * ay * cc, -cx * by * aa)
        return sum(terms), sum(map(abs, terms))

    value, size = det(float)
    if abs(value) > 1e-12 * size:
        return 1 if value > 0 else -1
    value, _ = det(Fraction)
    return (value > 0) - (value < 0)


def triangulate(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles as counter-clockwise indices of distinct points, each from its least index. None if all points lie on a line."""
    pts = [tuple(map(float, p)) for p in points]
    order = _along_curve(np.asarray(points, float)) if len(pts) else []
    first = next((k for k in range(2, len(order)) if orient(pts[order[0]], pts[order[1]], pts[order[k]])), None)
    if first is None:
        return []
    order = [order[0], order[1], order[first], *order[2:first], *order[first + 1 :]]
    a, b, c = order[:3]
    if orient(pts[a], pts[b], pts[c]) < 0:
        b, c = c, b
    # The triangle on the left of each directed edge, named by its third corner.
    apex = {(a, b): c, (b, c): a, (c, a): b}
    for u, v in ((b, a), (c, b), (a, c)):
        apex[u, v], apex[v, GHOST], apex[GHOST, u] = GHOST, u, v

    def conflicts(u, v, w, p) -> bool:
        if GHOST in (u, v, w):
            while u != GHOST:
                u, v, w = v, w, u
            s = orient(pts[v], pts[w], pts[p])  # beyond the hull edge w -> v
            if s:
                return s > 0
            lo, hi = sorted((pts[v], pts[w]))
            return lo < pts[p] < hi
        return in_circle(pts[u], pts[v], pts[w], pts[p]) > 0

    last = (a, b)
    for p in order[3:]:
        start = _locate(apex, pts, last, p)
        u, v = start
        cavity, work, border = {(u, v, apex[u, v])}, [(u, v), (v, apex[u, v]), (apex[u, v], u)], []
        gone = set(work)
        while work:
            u, v = work.pop()
            w = apex[v, u]
            if (v, u) in gone:
                continue
            if conflicts(v, u, w, p):
                for e in ((v, u), (u, w), (w, v)):
                    gone.add(e)
                work += [(u, w), (w, v)]
            else:
                border.append((u, v))
        border = [(u, v) for u, v in border if (v, u) not in gone]
        for e in gone:
            apex.pop(e, None)
        for u, v in border:
            apex[u, v], apex[v, p], apex[p, u] = p, u, v
        last = next(((u, v) for u, v in border if u != GHOST and v != GHOST), border[0])
    return sorted({(u, v, w) for (u, v), w in apex.items() if w != GHOST and u != GHOST and v != GHOST and u < v and u < w})


def _along_curve(points: np.ndarray) -> list[int]:
    """Indices in Z-order, so that each point is near the one before."""
    low = points.min(axis=0)
    extent = float((points.max(axis=0) - low).max()) or 1.0
    q = ((points - low) / extent * 65535).astype(np.int64)
    z = np.zeros(len(q), np.int64)
    for k in range(16):
        z |= ((q[:, 0] >> k & 1) << (2 * k + 1)) | ((q[:, 1] >> k & 1) << (2 * k))
    return np.argsort(z, kind="stable").tolist()


def _locate(apex: dict, pts: list, edge: tuple, p: int) -> tuple[int, int]:
    """An edge of a triangle that p conflicts with: a walk towards p."""
    u, v = edge
    if GHOST in (u, v) or apex[u, v] == GHOST:
        w = apex[u, v]
        tri = [x for x in (u, v, w) if x != GHOST]
        u, v = (tri[0], tri[1]) if (tri[0], tri[1]) in apex and apex[tri[0], tri[1]] != GHOST else (tri[1], tri[0])
    for _ in range(10 * len(pts) + 10):
        w = apex[u, v]
        if w == GHOST:
            return u, v
        for a, b in ((u, v), (v, w), (w, u)):
            if orient(pts[a], pts[b], pts[p]) < 0:
                u, v = b, a
                break
        else:
            return u, v
    raise RuntimeError("the walk did not end")


def circumcircle(a, b, c) -> tuple[float, float, float]:
    """Centre and radius."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + x, a[1] + y, float(np.hypot(x, y))


def split_safe(points: np.ndarray, triangles: list, box: tuple[float, float, float, float]) -> tuple[list, set[int]]:
    """(triangles whose circumcircle lies within the box, so that no point outside can undo them; sites with any other triangle or on the hull)."""
    x1, y1, x2, y2 = box
    safe, rest, edges = [], set(), {}
    for t in triangles:
        x, y, r = circumcircle(*(points[i] for i in t))
        r *= 1 + 1e-9
        if x - r >= x1 and x + r <= x2 and y - r >= y1 and y + r <= y2:
            safe.append(t)
        else:
            rest.update(t)
        for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            edges[e] = True
    rest.update(i for u, v in edges if (v, u) not in edges for i in (u, v))
    rest.update(set(range(len(points))) - {i for t in triangles for i in t})
    return safe, rest


def merge(points: np.ndarray, borders: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Triangles of the sites that remain, without those that lie where safe triangles are. ``borders``: directed edges with a safe triangle on their left."""
    triangles = triangulate(points)
    apex = {(u, v): (t, w) for t in triangles for u, v, w in (t, t[1:] + t[:1], t[2:] + t[:2])}
    barrier, gone = {(v, u) for u, v in borders}, set()
    work = [e for e in borders if e in apex]
    while work:
        u, v = work.pop()
        t, w = apex[u, v]
        if t in gone:
            continue
        gone.add(t)
        for e in ((w, v), (u, w)):
            if e in apex and e not in barrier:
                work.append(e)
    return [t for t in triangles if t not in gone]


def settle(points: np.ndarray, borders: list[tuple[int, int]], box: tuple[float, float, float, float]) -> tuple[list, set[int], list[tuple[int, int]]]:
    """What is left of several cells, put together: (triangles that no point outside the box can undo, sites that have others yet, directed edges with a
    settled triangle on their left and none on their right)."""
    x1, y1, x2, y2 = box
    safe, open_ = [], []
    for t in merge(points, borders):
        x, y, r = circumcircle(*(points[i] for i in t))
        r *= 1 + 1e-9
        (safe if x - r >= x1 and x + r <= x2 and y - r >= y1 and y + r <= y2 else open_).append(t)
    around = lambda t: ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))
    settled = {*borders, *(e for t in safe for e in around(t))}
    edges = settled | {e for t in open_ for e in around(t)}
    rest = {i for t in open_ for i in t}
    rest |= {i for u, v in edges if (v, u) not in edges for i in (u, v)} if not all(map(np.isinf, box)) else set()
    seen = {i for e in edges for i in e}
    rest |= set(range(len(points))) - seen if not all(map(np.isinf, box)) else set()
    return safe, rest, [(u, v) for u, v in settled if (v, u) not in settled]
