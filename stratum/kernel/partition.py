"""Space partitioners, built from a sample on the driver.

A partitioner names cells; ``assign`` gives each point one cell, ``overlaps`` all cells that a rectangle
touches (disjoint partitioners only). Both work on numpy arrays; the Spark side ships the partitioner to
tasks. Cells of disjoint partitioners tile the plane: the outermost reach to infinity.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

INF = math.inf
#: Entries of a tiling's table of cells (four bytes each).
SLOTS = 1 << 20
#: Cells in a leaf of the tree over a tiling with more edges, and numbers that a comparison of points with all cells holds at a time.
LEAF, CHUNK = 8, 1 << 18


class _Tree:
    """Finds cells of a tiling by halving the plane: nodes as arrays, so that points go down level by level, all at once."""

    def __init__(self, b: np.ndarray) -> None:
        self.axis, self.at, self.low, leaves = [0], [0.0], [-1], {}
        work = [(0, np.arange(len(b)))]
        while work:
            node, k = work.pop()
            best = None
            for axis in (0, 1) if len(k) > LEAF else ():
                edges = b[k][:, [axis, axis + 2]]
                inner = np.unique(edges[np.isfinite(edges)])
                if len(inner):
                    low, high = np.sort(edges[:, 0]), np.sort(edges[:, 1])
                    # Cells that begin before an edge go down on its left, those that end beyond it on its right.
                    larger = np.maximum(np.searchsorted(low, inner, "left"), len(k) - np.searchsorted(high, inner, "right"))
                    j = int(larger.argmin())
                    best = min(best or (len(k), 0, 0.0), (int(larger[j]), axis, float(inner[j])))
            if best is None or best[0] >= len(k):
                leaves[node] = k
                continue
            _, axis, at = best
            self.axis[node], self.at[node], self.low[node] = axis, at, len(self.at)
            for part in (k[b[k, axis] < at], k[b[k, axis + 2] > at]):
                work.append((len(self.at), part))
                self.axis.append(0), self.at.append(0.0), self.low.append(-1)
        self.axis, self.at, self.low = np.array(self.axis), np.array(self.at), np.array(self.low)
        self.cells = np.full((len(self.at), max((len(k) for k in leaves.values()), default=1) or 1), -1, np.int32)
        for node, k in leaves.items():
            self.cells[node, : len(k)] = k

    def pairs(self, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
        """(places of rectangles, cells that may touch them)."""
        row, node, low, high = np.arange(len(x1)), np.zeros(len(x1), np.int64), np.stack([x1, y1]), np.stack([x2, y2])
        done = []
        while len(row):
            leaf = self.low[node] < 0
            done.append((row[leaf], node[leaf]))
            row, node = row[~leaf], node[~leaf]
            a, at = self.axis[node], self.at[node]
            left = low[a, row] < at
            right = ~left | (high[a, row] > at)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.low[node[left]], self.low[node[right]] + 1])
        row, node = (np.concatenate(v) if done else np.zeros(0, np.int64) for v in zip(*done)) if done else (row, node)
        cells = self.cells[node]
        i, j = np.nonzero(cells >= 0)
        return row[i], cells[i, j]


@dataclass
class Cells:
    """Cells given as rectangles; a point goes to the cell that holds it (half-open) or, outside all, to that which grows least, then to the smallest."""

    boxes: np.ndarray  # rows x1, y1, x2, y2
    ids: np.ndarray
    disjoint: bool = True
    name: str = "cells"

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_slots"}

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """For tilings: the sorted edges in x and y and the cell between each two of them, so that a point is found by two
        binary searches. None where the cells overlap or their edges cross too often."""
        if "_slots" not in self.__dict__:
            self._slots = None
            b = self.boxes
            xs, ys = (np.unique(b[:, [k, k + 2]][np.isfinite(b[:, [k, k + 2]])]) for k in (0, 1))
            if self.disjoint and (len(xs) + 1) * (len(ys) + 1) <= SLOTS:
                table = np.full((len(xs) + 1, len(ys) + 1), -1, np.int32)
                first = lambda edges, v: np.searchsorted(edges, v, side="right")
                last = lambda edges, v: np.searchsorted(edges, v, side="left")
                for k, (i, j, m, n) in enumerate(zip(first(xs, b[:, 0]), first(ys, b[:, 1]), last(xs, b[:, 2]), last(ys, b[:, 3]))):
                    table[i : m + 1, j : n + 1] = k
                self._slots = xs, ys, table
        return self._slots

    def prepare(self) -> None:
        """Builds the tree where it will be needed, so that it travels with the partitioner and isn't built in each task."""
        if self.disjoint and self.slots() is None and "_tree" not in self.__dict__:
            self._tree = _Tree(self.boxes)

    def touching(self, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
        """(places of rectangles, cells that they touch) of disjoint cells, by places."""
        if "_tree" not in self.__dict__:
            self._tree = _Tree(self.boxes)
        x1, y1, x2, y2 = (np.asarray(v, float) for v in (x1, y1, x2, y2))
        row, k = self._tree.pairs(x1, y1, x2, y2)
        a, c, d, e, b = x1[row], y1[row], x2[row], y2[row], self.boxes[k]
        hit = (a < b[:, 2]) & ((d > b[:, 0]) | (a >= b[:, 0])) & (c < b[:, 3]) & ((e > b[:, 1]) | (c >= b[:, 1]))
        both = np.unique(np.stack([row[hit], k[hit]], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def assign(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if slots := self.slots():
            xs, ys, table = slots
            k = table[np.searchsorted(xs, x, side="right"), np.searchsorted(ys, y, side="right")]
            if len(out := np.flatnonzero(k < 0)):  # outside all cells
                ids = np.empty(len(k), np.int64)
                ids[k >= 0] = self.ids[k[k >= 0]]
                ids[out] = self._nearest(x[out], y[out])
                return ids
            return self.ids[k]
        if self.disjoint and len(x):
            row, k = self.touching(x, y, x, y)
            ids, out = np.empty(len(x), np.int64), np.ones(len(x), bool)
            ids[row], out[row] = self.ids[k], False
            if out.any():
                ids[out] = self._nearest(x[out], y[out])
            return ids
        return self._nearest(x, y)

    def _nearest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        b = self.boxes
        out = np.empty(len(x), np.int64)
        step = max(1, CHUNK // max(len(b), 1))
        for i in range(0, len(x), step):
            px, py = x[i : i + step, None], y[i : i + step, None]
            inside = (px >= b[:, 0]) & (px < b[:, 2]) & (py >= b[:, 1]) & (py < b[:, 3])
            size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
            finite = np.where(np.isfinite(size), size, 1e300)
            with np.errstate(invalid="ignore"):
                grown = (np.maximum(b[:, 2], px) - np.minimum(b[:, 0], px)) * (np.maximum(b[:, 3], py) - np.minimum(b[:, 1], py))
            cost = np.where(inside, -1.0, np.where(np.isfinite(grown), grown - finite, 1e300))
            best = cost.min(axis=1, keepdims=True)
            out[i : i + step] = np.argmin(np.where(cost == best, finite, np.inf), axis=1)
        return self.ids[out]

    def overlaps(self, x1, y1, x2, y2) -> list[np.ndarray]:
        """A rectangle without extent is in the cell of its point."""
        b, out = self.boxes, []
        if slots := self.slots():
            xs, ys, table = slots
            i, j = np.searchsorted(xs, x1, side="right"), np.searchsorted(ys, y1, side="right")
            m, n = np.maximum(i, np.searchsorted(xs, x2, side="left")), np.maximum(j, np.searchsorted(ys, y2, side="left"))
            for a, c, d, e, one in zip(i.tolist(), j.tolist(), m.tolist(), n.tolist(), table[i, j].tolist()):
                k = np.array([one]) if a == d and c == e else np.unique(table[a : d + 1, c : e + 1])
                out.append(self.ids[k[k >= 0]])
            return out
        if self.disjoint and len(x1):
            row, k = self.touching(x1, y1, x2, y2)
            return np.split(self.ids[k], np.searchsorted(row, np.arange(1, len(x1))))
        for a, c, d, e in zip(x1, y1, x2, y2):
            hit = (a < b[:, 2]) & ((d > b[:, 0]) | (a >= b[:, 0])) & (c < b[:, 3]) & ((e > b[:, 1]) | (c >= b[:, 1]))
            out.append(self.ids[hit])
        return out


@dataclass
class Curve:
    """Ranges of a space-filling curve; cells overlap, so only ``assign``."""

    box: tuple
    splits: np.ndarray
    kind: str
    name: str = "curve"
    disjoint: bool = False
    ids: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.ids = np.arange(len(self.splits) + 1)

    def values(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = self.box
        top = (1 << 15) - 1
        scale = lambda v, a, b: np.clip(((v - a) / ((b - a) or 1.0) * top).astype(np.int64), 0, top)
        u, v = scale(x, x1, x2), scale(y, y1, y2)
        return z_values(u, v) if self.kind == "zcurve" else hilbert_values(u, v)

    def assign(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.splits, self.values(x, y), side="right")


def z_values(u: np.ndarray, v: np.ndarray, bits: int = 15) -> np.ndarray:
    """x on the odd bits."""
    z = np.zeros(len(u), np.int64)
    for k in range(bits):
        z |= ((u >> k & 1) << (2 * k + 1)) | ((v >> k & 1) << (2 * k))
    return z


def hilbert_values(u: np.ndarray, v: np.ndarray, order: int = 15) -> np.ndarray:
    x, y, d = u.copy(), v.copy(), np.zeros(len(u), np.int64)
    for k in reversed(range(order)):
        s = 1 << k
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += s * s * ((3 * rx) ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return d


def _grid(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
    """About n square tiles; ids in row order from 0."""
    x1, y1, x2, y2 = box
    w, h = (x2 - x1) or 1.0, (y2 - y1) or 1.0
    side = math.sqrt(w * h / max(n, 1))
    cols, rows = max(1, round(w / side)), max(1, round(h / side))
    xs = [-INF, *[x1 + w * k / cols for k in range(1, cols)], INF]
    ys = [-INF, *[y1 + h * k / rows for k in range(1, rows)], INF]
    return _tiles([(xs[c], ys[r], xs[c + 1], ys[r + 1]) for r in range(rows) for c in range(cols)], "grid")


def _tiles(boxes: list, name: str, ids=None, disjoint: bool = True) -> Cells:
    return Cells(np.array(boxes, float).reshape(-1, 4), np.arange(len(boxes)) if ids is None else np.array(ids), disjoint, name)


def _str(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
    """Columns by quantiles of x, in each rows by quantiles of y; ids column by column."""
    k = max(1, math.ceil(math.sqrt(n)))
    p = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    xs = _bounds(p[:, 0], k)
    out = []
    for a, b in zip(xs, xs[1:]):
        column = p[(p[:, 0] >= a) & (p[:, 0] < b)]
        ys = _bounds(np.sort(column[:, 1]), k)
        out += [(a, c, b, d) for c, d in zip(ys, ys[1:])]
    return _tiles(out, "str")


def _bounds(values: np.ndarray, k: int) -> list[float]:
    if not len(values):
        return [-INF, INF]
    inner = sorted({float(values[len(values) * i // k]) for i in range(1, k)} - {float(values[0])})
    return [-INF, *inner, INF]


def _kd(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
    """Halved at medians, x and y in turn; numbered as the leaves of a heap, from the number of leaves on."""
    depth = max(0, math.ceil(math.log2(max(n, 1))))
    out = {}

    def split(node, b, pts, level):
        if level == depth:
            out[node] = b
            return
        axis = level % 2
        v = np.sort(pts[:, axis])
        at = float(v[len(v) // 2]) if len(v) else (b[axis] + b[axis + 2]) / 2 if np.isfinite(b[axis] + b[axis + 2]) else 0.0
        low, high = list(b), list(b)
        low[axis + 2] = high[axis] = at
        split(2 * node, tuple(low), pts[pts[:, axis] < at], level + 1)
        split(2 * node + 1, tuple(high), pts[pts[:, axis] >= at], level + 1)

    split(1, (-INF, -INF, INF, INF), sample, 0)
    return _tiles(list(out.values()), "kdtree", list(out))


def _quad(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
    """Quartered while a quarter has more than its share of the sample; a node's children are 4 * id + 0..3."""
    limit = max(1, len(sample) // max(n, 1))
    out = {}

    def split(node, b, edge, pts, depth):
        if len(pts) <= limit or depth == 20:
            out[node] = edge
            return
        mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
            c = (mx if i else b[0], my if j else b[1], b[2] if i else mx, b[3] if j else my)
            e = (mx if i else edge[0], my if j else edge[1], edge[2] if i else mx, edge[3] if j else my)
            inside = ((pts[:, 0] >= mx) == bool(i)) & ((pts[:, 1] >= my) == bool(j))
            split(4 * node + k, c, e, pts[inside], depth + 1)

    split(1, box, (-INF, -INF, INF, INF), sample, 0)
    return _tiles(list(out.values()), "quadtree", list(out))


def _bulk(measure: str, name: str):
    """R-tree bulk splits of the sample: along the axis of least total perimeter, at the place of least area or perimeter, until parts have the capacity."""

    def build(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
        most = max(1, math.ceil(len(sample) / max(n, 1)))
        least = max(1, int(most * 0.4))
        out = []

        def place(orders: tuple) -> tuple[int, int] | None:
            """(axis, place) of the split; ``orders`` has the points sorted by x and by y, each as columns x and y."""
            best = None
            for axis in (0, 1):
                p, q = orders[axis][axis], orders[axis][1 - axis]
                k = np.arange(least, len(p) - least + 1, max(1, len(p) // 256))
                k = k[p[k - 1] < p[k]]
                if not len(k):
                    continue
                at = np.concatenate([[0], k])
                low, high = np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)
                before = np.maximum.accumulate(high)[:-1] - np.minimum.accumulate(low)[:-1]
                after = (np.maximum.accumulate(high[::-1])[::-1] - np.minimum.accumulate(low[::-1])[::-1])[1:]
                d1, d2 = (np.stack(d if axis == 0 else d[::-1], axis=1) for d in ((p[k - 1] - p[0], before), (p[-1] - p[k], after)))
                perimeter = d1.sum(axis=1) + d2.sum(axis=1)
                value = perimeter if measure == "perimeter" else d1.prod(axis=1) + d2.prod(axis=1) if measure == "area" else np.abs(k - len(p) / 2)
                found = (float(perimeter.sum()), axis, int(k[int(value.argmin())]))
                best = found if best is None or found[0] < best[0] else best
            return best and best[1:]

        # A stack in place of recursion: a split may cut off a few points only, so the depth can be near the number of cells. Parts are copies, so no point is held twice.
        work = [(tuple(tuple(np.ascontiguousarray(c) for c in sample[np.lexsort((sample[:, 1 - a], sample[:, a]))].T) for a in (0, 1)), (-INF, -INF, INF, INF))]
        while work:
            orders, edge = work.pop()
            found = place(orders) if len(orders[0][0]) > most else None
            if found is None:
                out.append(edge)
                continue
            axis, k = found
            at = float(orders[axis][axis][k])
            low, high = list(edge), list(edge)
            low[axis + 2] = high[axis] = at
            below = [o[axis] < at for o in orders]
            work.append((tuple(tuple(c[~m] for c in o) for o, m in zip(orders, below)), tuple(high)))
            work.append((tuple(tuple(c[m] for c in o) for o, m in zip(orders, below)), tuple(low)))
        return _tiles(out, name)

    return build


class _Node:
    __slots__ = ("box", "children", "leaf", "origin")

    def __init__(self, children: list, leaf: bool) -> None:
        self.children, self.leaf = children, leaf
        self.fit()
        self.origin = self.centre()

    def centre(self) -> tuple[float, float]:
        return (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2

    def fit(self) -> None:
        b = np.array([c if self.leaf else c.box for c in self.children])
        self.box = (*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0))


def _size(b) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def _join(a, b) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _overlap(a, b) -> float:
    """Area that two boxes share; half the perimeter of what they share where boxes have no area."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    return w * h if _size(a) > 0 and _size(b) > 0 else w + h


def _margin(b) -> float:
    return b[2] - b[0] + b[3] - b[1]


def _revised_subtree(node: _Node, p: tuple) -> _Node:
    """The child to descend to by the revised R*-tree's rule: of those that hold the point the smallest; else that whose perimeter grows least, unless
    that costs overlap with its siblings, in which case the one of those next in order that costs least."""
    inside = [c for c in node.children if c.box[0] <= p[0] and c.box[1] <= p[1] and p[2] <= c.box[2] and p[3] <= c.box[3]]
    if inside:
        return min(inside, key=lambda c: (_size(c.box), _margin(c.box)))
    order = sorted(node.children, key=lambda c: _margin(_join(c.box, p)) - _margin(c.box))

    def cost(c: _Node) -> float:
        wide = _join(c.box, p)
        return sum(_overlap(wide, o.box) - _overlap(c.box, o.box) for o in node.children if o is not c)

    if cost(order[0]) <= 0:
        return order[0]
    return min(order[:32], key=lambda c: (cost(c), _margin(_join(c.box, p)) - _margin(c.box)))


def _revised_split(boxes: list, least: int, origin: tuple) -> tuple[list[int], int]:
    """(order, place) of the revised R*-tree's split: the axis of least perimeters, then the place of the best goal, weighted towards the side
    that the node has grown away from since it was made."""
    k, best = len(boxes), None
    whole = boxes[0]
    for b in boxes:
        whole = _join(whole, b)
    sides = whole[2] - whole[0], whole[3] - whole[1]
    most = 2 * sum(sides) - min(sides)
    for axis in (0, 1):
        total, splits = 0.0, []
        for low in (axis, axis + 2):
            order = sorted(range(k), key=lambda i: (boxes[i][low], boxes[i][axis + 2 if low == axis else axis]))
            heads, tails = [boxes[order[0]]], [boxes[order[-1]]]
            for i in order[1:]:
                heads.append(_join(heads[-1], boxes[i]))
            for i in reversed(order[:-1]):
                tails.append(_join(tails[-1], boxes[i]))
            for c in range(least, k - least + 1):
                a, b = heads[c - 1], tails[k - c - 1]
                total += _margin(a) + _margin(b)
                splits.append((order, c, a, b))
        if best is None or total < best[0]:
            best = total, axis, splits
    _, axis, splits = best
    asymmetry = 2 * ((whole[axis] + whole[axis + 2]) / 2 - origin[axis]) / (sides[axis] or 1.0)
    mu = (1 - 2 * least / k) * asymmetry
    spread, floor = 0.5 * (1 + abs(mu)), math.exp(-4)  # the paper's s = 0.5
    weight = lambda c: max((math.exp(-(((2 * c / k - 1 - mu) / spread) ** 2)) - floor) / (1 - floor), 1e-3)
    free = any(_overlap(a, b) == 0 for _, _, a, b in splits)

    def goal(split) -> float:
        _, c, a, b = split
        if free:
            return (_margin(a) + _margin(b) - most) * weight(c) if _overlap(a, b) == 0 else math.inf
        return _overlap(a, b) / weight(c)

    order, c, _, _ = min(splits, key=goal)
    return order, c


def _insertion(kind: str, name: str):
    """R-trees built by inserting the sample point by point; their leaves are the cells. ``kind``: linear or quadratic seeds, rstar (axis splits, and
    a share of an overfull leaf is inserted anew once) or rrstar (the revised rules for descent and split, nothing inserted anew)."""

    def build(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Cells:
        most = max(4, math.ceil(len(sample) / max(n, 1)) * 4 // 3)
        least = max(1, int(most * 0.4))

        def divide(items: list, boxes: list, origin: tuple) -> tuple[list, list]:
            k = len(items)
            if kind == "rrstar":
                order, c = _revised_split(boxes, least, origin)
                return [items[i] for i in order[:c]], [items[i] for i in order[c:]]
            if kind == "rstar":
                best = None
                for axis in (0, 1):
                    order = sorted(range(k), key=lambda i: (boxes[i][axis], boxes[i][axis + 2]))
                    heads, tails = [boxes[order[0]]], [boxes[order[-1]]]
                    for i in order[1:]:
                        heads.append(_join(heads[-1], boxes[i]))
                    for i in reversed(order[:-1]):
                        tails.append(_join(tails[-1], boxes[i]))
                    for c in range(least, k - least + 1):
                        a, b = heads[c - 1], tails[k - c - 1]
                        margin = a[2] - a[0] + a[3] - a[1] + b[2] - b[0] + b[3] - b[1]
                        common = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                        if best is None or (common, margin) < best[0]:
                            best = ((common, margin), order, c)
                _, order, c = best
                return [items[i] for i in order[:c]], [items[i] for i in order[c:]]
            if kind == "quadratic":
                pairs = ((_size(_join(boxes[i], boxes[j])) - _size(boxes[i]) - _size(boxes[j]), i, j) for i in range(k) for j in range(i))
                _, i, j = max(pairs)
            else:
                axis = max((0, 1), key=lambda a: (max(b[a] for b in boxes) - min(b[a + 2] for b in boxes)) / ((max(b[a + 2] for b in boxes) - min(b[a] for b in boxes)) or 1.0))
                i, j = max(range(k), key=lambda q: boxes[q][axis]), min(range(k), key=lambda q: boxes[q][axis + 2])
                j = j if i != j else (i + 1) % k
            a, b, ba, bb = [items[i]], [items[j]], boxes[i], boxes[j]
            rest = [q for q in range(k) if q not in (i, j)]
            for at, q in enumerate(rest):
                left = len(rest) - at
                if len(a) + left <= least:
                    to_a = True
                elif len(b) + left <= least:
                    to_a = False
                else:
                    ga, gb = _size(_join(ba, boxes[q])) - _size(ba), _size(_join(bb, boxes[q])) - _size(bb)
                    to_a = (ga, _size(ba), len(a)) <= (gb, _size(bb), len(b))
                if to_a:
                    a.append(items[q])
                    ba = _join(ba, boxes[q])
                else:
                    b.append(items[q])
                    bb = _join(bb, boxes[q])
            return a, b

        root, again = None, True

        def insert(p: tuple) -> None:
            nonlocal root, again
            if root is None:
                root = _Node([p], True)
                return
            path, node = [], root
            while not node.leaf:
                path.append(node)
                node = _revised_subtree(node, p) if kind == "rrstar" else min(node.children, key=lambda c: (_size(_join(c.box, p)) - _size(c.box), _size(c.box)))
            node.children.append(p)
            node.fit()
            for up in reversed(path):
                up.box = _join(up.box, p)
            if len(node.children) > most and kind == "rstar" and again and path:
                again = False
                cx, cy = (node.box[0] + node.box[2]) / 2, (node.box[1] + node.box[3]) / 2
                far = heapq.nlargest(max(1, most * 3 // 10), node.children, key=lambda c: (c[0] - cx) ** 2 + (c[1] - cy) ** 2)
                for f in far:
                    node.children.remove(f)
                node.fit()
                for up in reversed(path):
                    up.fit()
                for f in far:
                    insert(f)
                again = True
                return
            while len(node.children) > most:
                boxes = [c if node.leaf else c.box for c in node.children]
                a, b = divide(node.children, boxes, node.origin)
                node.children = a
                node.fit()
                node.origin = node.centre()
                other = _Node(b, node.leaf)
                if not path:
                    root = _Node([node, other], False)
                    return
                node = path.pop()
                node.children.append(other)
                node.fit()

        for x, y in sample.tolist():
            insert((x, y, x, y))
        out, work = [], [root] if root else []
        while work:
            node = work.pop()
            out.append(node.box) if node.leaf else work.extend(reversed(node.children))
        return _tiles(out or [box], name, disjoint=False)

    return build


def _curve(kind: str):
    def build(box: tuple, n: int, sample: np.ndarray, capacity: int) -> Curve:
        c = Curve(box, np.zeros(0, np.int64), kind, kind)
        v = np.sort(c.values(sample[:, 0], sample[:, 1])) if len(sample) else np.zeros(0, np.int64)
        return Curve(box, np.unique([v[len(v) * k // n] for k in range(1, n)]) if len(v) and n > 1 else np.zeros(0, np.int64), kind, kind)

    return build


BUILDERS = {
    "grid": _grid, "str": _str, "rtreegb": _bulk("balance", "rtreegb"), "rstar": _bulk("area", "rstar"), "rrstar": _bulk("perimeter", "rrstar"),
    "rtreebb": _insertion("linear", "rtreebb"), "rtreebbq": _insertion("quadratic", "rtreebbq"), "rstreebb": _insertion("rstar", "rstreebb"), "rrstreebb": _insertion("rrstar", "rrstreebb"),
    "kdtree": _kd, "zcurve": _curve("zcurve"), "hilbert": _curve("hilbert"), "quadtree": _quad,
}
#: Named combinations: builder and whether rows are replicated to all cells that they touch.
NAMED = {"grid": ("grid", True), "str": ("str", False), "str+": ("str", True), "rtree": ("rstar", False), "r+tree": ("rstar", True), "quadtree": ("quadtree", True), "kdtree": ("kdtree", True), "zcurve": ("zcurve", False), "hilbert": ("hilbert", False)}


def build(kind: str, box: tuple, n: int, sample: np.ndarray) -> Cells | Curve:
    """A partitioner of about ``n`` cells over ``box`` from sample points."""
    capacity = max(1, len(sample) // max(n, 1))
    return BUILDERS[kind](tuple(box), max(1, n), np.asarray(sample, float).reshape(-1, 2), capacity)


def register(name: str, builder) -> None:
    """Adds a partitioner of the user: a function of (box, n, sample, capacity)."""
    BUILDERS[name] = builder
