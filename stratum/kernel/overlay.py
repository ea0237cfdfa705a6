"""Union of polygons by arranging their edges.

All edges are split where they cross or touch each other; a piece is on the boundary of the union if the
polygons cover just one of its sides. Boundary pieces are joined to rings, the covered side left. Coordinates are whole multiples of a common
power of two, and rationals at crossings, so the arrangement is exact; results are doubles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

from stratum.kernel.shapes import flatten


def _rings(polygon: tuple) -> list[list]:
    out = []
    for r in polygon[1]:
        pts = [p for i, p in enumerate(r) if i == 0 or p != r[i - 1]]
        if len(pts) > 1 and pts[0] == pts[-1]:
            pts = pts[:-1]
        if len(pts) > 2:
            out.append(pts)
    return out


def _whole(polygons: list[list]) -> tuple[list[list], int]:
    """Coordinates times the least power of two that makes all of them even whole numbers (so that middles are whole too), and that power."""
    ratios = {v: float(v).as_integer_ratio() for rings in polygons for r in rings for p in r for v in p}
    scale = 2 * max((q for _, q in ratios.values()), default=1)
    whole = {v: n * (scale // q) for v, (n, q) in ratios.items()}
    return [[[(whole[x], whole[y]) for x, y in r] for r in rings] for rings in polygons], scale


def _ratio(n, q):
    """n / q, whole if it can be."""
    v = Fraction(n, q)
    return v.numerator if v.denominator == 1 else v


def _half(v):
    return v >> 1 if isinstance(v, int) and not v & 1 else Fraction(v) / 2


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _cuts(s: tuple, t: tuple) -> list:
    """Points at which segment ``t`` meets segment ``s``."""
    (a, b), (c, d) = s, t
    r, q = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    den = _cross(*r, *q)
    w = (c[0] - a[0], c[1] - a[1])
    if den == 0:
        if _cross(*w, *r) != 0:
            return []
        n = r[0] * r[0] + r[1] * r[1]
        return [p for p in (c, d) if 0 <= (p[0] - a[0]) * r[0] + (p[1] - a[1]) * r[1] <= n]
    u, v = _cross(*w, *q), _cross(*w, *r)
    if den < 0:
        den, u, v = -den, -u, -v
    if not (0 <= u <= den and 0 <= v <= den):
        return []
    return [a if u == 0 else b if u == den else (_ratio(a[0] * den + u * r[0], den), _ratio(a[1] * den + u * r[1], den))]


def _inside(p: tuple, rings: list) -> bool:
    hit = False
    for r in rings:
        for a, b in zip(r, [*r[1:], r[0]]):
            if (a[1] > p[1]) != (b[1] > p[1]) and _cross(b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]) * (1 if b[1] > a[1] else -1) > 0:
                hit = not hit
    return hit


def _pieces(polygons: list[list]) -> set:
    """Undirected pieces of all edges, split at each other."""
    edges = [(a, b) for rings in polygons for r in rings for a, b in zip(r, [*r[1:], r[0]])]
    boxes = sorted(((min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])), k) for k, (a, b) in enumerate(edges))
    points = [{a, b} for a, b in edges]
    active: list = []
    for bx, k in boxes:
        active = [x for x in active if x[0][1] >= bx[0]]
        for ox, j in active:
            if ox[3] >= bx[2] and bx[3] >= ox[2]:
                points[k].update(_cuts(edges[k], edges[j]))
                points[j].update(_cuts(edges[j], edges[k]))
        active.append((bx, k))
    out = set()
    for (a, _), ps in zip(edges, points):
        line = sorted(ps, key=lambda p: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)
        out.update((min(p, q), max(p, q)) for p, q in zip(line, line[1:]) if p != q)
    return out


def _sides(piece: tuple, polygons: list[tuple]) -> tuple[bool, bool]:
    """Whether the polygons, each with its rectangle, cover the left and the right of a piece."""
    (a, b) = piece
    mid = _half(a[0] + b[0]), _half(a[1] + b[1])
    left = right = False
    for rings, (x1, y1, x2, y2) in polygons:
        if not (x1 <= mid[0] <= x2 and y1 <= mid[1] <= y2):
            continue
        on = False
        base = _inside(mid, rings)
        for r in rings:
            for c, d in zip(r, [*r[1:], r[0]]):
                if _cross(d[0] - c[0], d[1] - c[1], mid[0] - c[0], mid[1] - c[1]) == 0 and min(c[0], d[0]) <= mid[0] <= max(c[0], d[0]) and min(c[1], d[1]) <= mid[1] <= max(c[1], d[1]):
                    on = not on
        if not on:
            left, right = left or base, right or base
            continue
        # The ray to +x of _inside counts an edge through the point as crossed if the point is strictly left of it: on it, not. So
        # ``base`` is the state just right of the edge (for edges that aren't horizontal), just above it (for horizontal ones).
        dx, dy = b[0] - a[0], b[1] - a[1]
        if dy > 0:
            left, right = left or not base, right or base
        elif dy < 0:
            left, right = left or base, right or not base
        elif dx > 0:
            left, right = left or base, right or not base
        else:
            left, right = left or not base, right or base
        if left and right:
            break
    return left, right


def union(geometries: list[tuple]) -> tuple:
    """The union of all polygons in them, as POLYGON or MULTIPOLYGON."""
    polygons = [r for g in geometries for s in flatten(g) if s[0] == "POLYGON" and (r := _rings(s))]
    polygons, scale = _whole(polygons)
    boxed = [(rings, (min(xs := [p[0] for r in rings for p in r]), min(ys := [p[1] for r in rings for p in r]), max(xs), max(ys))) for rings in polygons]
    outgoing = defaultdict(list)
    for a, b in _pieces(polygons):
        left, right = _sides((a, b), boxed)
        if left != right:
            p, q = (a, b) if left else (b, a)
            outgoing[p].append(q)
    rings = _chain(outgoing, scale)
    shells, holes = [], []
    for r in rings:
        s = sum(_cross(*p, *q) for p, q in zip(r, [*r[1:], r[0]]))
        (shells if s > 0 else holes).append((abs(s), r))
    shells.sort(key=lambda x: x[0])
    parts = [[r] for _, r in shells]
    for _, h in holes:
        probe = _just_inside(h)
        for part in parts:
            if _inside(probe, [part[0]]):
                part.append(h)
                break
    close = lambda r: [(_float(x, scale), _float(y, scale)) for x, y in [*r, r[0]]]
    out = sorted([close(r) for r in part] for part in parts)
    return ("POLYGON", out[0]) if len(out) == 1 else ("MULTIPOLYGON", out)


def _just_inside(ring: list) -> tuple:
    """A point of a hole's edge moved a little to its left, where the union lies."""
    a, b = ring[0], ring[1]
    return _half(a[0] + b[0]), _half(a[1] + b[1])


def _float(v, scale: int) -> float:
    return v / scale if isinstance(v, int) else float(v / scale)


def _chain(outgoing: dict, scale: int) -> list[list]:
    """Rings of directed pieces; at a point where several leave, the one that turns most to the right, so rings that only touch stay apart."""
    rings = []
    starts = sorted(outgoing)
    for s in starts:
        while outgoing[s]:
            ring, p, q = [s], s, outgoing[s].pop()
            while q != s:
                ring.append(q)
                options = outgoing[q]
                if len(options) > 1:
                    angle = lambda o, q=q: math.atan2(_float(o[1] - q[1], scale), _float(o[0] - q[0], scale))
                    back = angle(p)
                    options.sort(key=lambda o: (angle(o) - back) % (2 * math.pi))
                p, q = q, options.pop()
            rings.append(_straight(ring))
    return [r for r in rings if len(r) > 2]


def _straight(ring: list) -> list:
    """Without the points in the middle of straight lines."""
    n = len(ring)
    return [ring[i] for i in range(n) if _cross(ring[i][0] - ring[i - 1][0], ring[i][1] - ring[i - 1][1], ring[(i + 1) % n][0] - ring[i][0], ring[(i + 1) % n][1] - ring[i][1]) != 0]
