"""Column expressions over points (x, y) and rectangles (x1, y1, x2, y2).

Rectangles meet if their interiors overlap. A point is in a rectangle if x1 <= x < x2 and y1 <= y < y2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Rect:
    """A rectangle of four columns or numbers."""

    x1: object
    y1: object
    x2: object
    y2: object

    def cols(self) -> tuple[Column, ...]:
        return tuple(map(_c, (self.x1, self.y1, self.x2, self.y2)))


def rect(prefix: str = "") -> Rect:
    """The rectangle in columns x1..y2 behind an alias or struct prefix."""
    return Rect(*[f"{prefix}{c}" for c in BOX])


def area(r: Rect) -> Column:
    return width(r) * height(r)


def width(r: Rect) -> Column:
    a, _, c, _ = r.cols()
    return c - a


def height(r: Rect) -> Column:
    _, b, _, d = r.cols()
    return d - b


def centre(r: Rect) -> tuple[Column, Column]:
    a, b, c, d = r.cols()
    return (a + c) / 2, (b + d) / 2


def buffered(r: Rect, dx: float, dy: float) -> Rect:
    a, b, c, d = r.cols()
    return Rect(a - dx, b - dy, c + dx, d + dy)


def translated(r: Rect, dx: float, dy: float) -> Rect:
    a, b, c, d = r.cols()
    return Rect(a + dx, b + dy, c + dx, d + dy)


def expanded(r: Rect, s: Rect) -> Rect:
    """The least rectangle around both."""
    (a, b, c, d), (e, f, g, h) = r.cols(), s.cols()
    return Rect(F.least(a, e), F.least(b, f), F.greatest(c, g), F.greatest(d, h))


def meets(r: Rect, s: Rect) -> Column:
    (a, b, c, d), (e, f, g, h) = r.cols(), s.cols()
    return (c > e) & (g > a) & (d > f) & (h > b)


def touches(r: Rect, s: Rect) -> Column:
    """Closed: common edges and corners count."""
    (a, b, c, d), (e, f, g, h) = r.cols(), s.cols()
    return (c >= e) & (g >= a) & (d >= f) & (h >= b)


def has_point(r: Rect, x, y) -> Column:
    a, b, c, d = r.cols()
    return (_c(x) >= a) & (_c(x) < c) & (_c(y) >= b) & (_c(y) < d)


def contains(r: Rect, s: Rect) -> Column:
    (a, b, c, d), (e, f, g, h) = r.cols(), s.cols()
    return (a <= e) & (b <= f) & (c >= g) & (d >= h)


def intersection(r: Rect, s: Rect) -> Column:
    """Struct of the common rectangle; null if the interiors don't overlap."""
    (a, b, c, d), (e, f, g, h) = r.cols(), s.cols()
    return F.when(meets(r, s), F.struct(F.greatest(a, e).alias("x1"), F.greatest(b, f).alias("y1"), F.least(c, g).alias("x2"), F.least(d, h).alias("y2")))


def reference_point(r: Rect, s: Rect) -> tuple[Column, Column]:
    """Low corner of the common part: lies in exactly one cell of a disjoint partitioning."""
    (a, b, _, _), (e, f, _, _) = r.cols(), s.cols()
    return F.greatest(a, e), F.greatest(b, f)


def distance(x, y, u, v) -> Column:
    dx, dy = _c(x) - _c(u), _c(y) - _c(v)
    return F.sqrt(dx * dx + dy * dy)


def max_distance(r: Rect, x, y) -> Column:
    """To the farthest corner: the distance by which rectangles rank."""
    a, b, c, d = r.cols()
    dx, dy = F.greatest(F.abs(_c(x) - a), F.abs(c - _c(x))), F.greatest(F.abs(_c(y) - b), F.abs(d - _c(y)))
    return F.sqrt(dx * dx + dy * dy)


def min_distance(r: Rect, x, y) -> Column:
    a, b, c, d = r.cols()
    dx, dy = F.greatest(a - _c(x), F.lit(0.0), _c(x) - c), F.greatest(b - _c(y), F.lit(0.0), _c(y) - d)
    return F.sqrt(dx * dx + dy * dy)


def wkt(r: Rect) -> Column:
    a, b, c, d = (x.cast("string") for x in r.cols())
    p = lambda x, y: F.concat(x, F.lit(" "), y)
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", p(a, b), p(c, b), p(c, d), p(a, d), p(a, b)), F.lit("))"))


@dataclass(frozen=True)
class Grid:
    """Cells of equal size over a rectangle, in row order from ``first_id``."""

    x1: float
    y1: float
    x2: float
    y2: float
    columns: int
    rows: int
    first_id: int = 1

    @property
    def cell_width(self) -> float:
        return (self.x2 - self.x1) / self.columns or 1.0

    @property
    def cell_height(self) -> float:
        return (self.y2 - self.y1) / self.rows or 1.0

    def column_of(self, x) -> Column:
        return F.floor((_c(x) - self.x1) / self.cell_width)

    def row_of(self, y) -> Column:
        return F.floor((_c(y) - self.y1) / self.cell_height)

    def clamp_column(self, k: Column) -> Column:
        return F.least(F.greatest(k, F.lit(0)), F.lit(self.columns - 1))

    def clamp_row(self, k: Column) -> Column:
        return F.least(F.greatest(k, F.lit(0)), F.lit(self.rows - 1))

    def cell_id(self, column: Column, row: Column) -> Column:
        return row * self.columns + column + self.first_id

    def cell_of_point(self, x, y) -> Column:
        """-1 outside."""
        c, r = self.column_of(x), self.row_of(y)
        inside = (c >= 0) & (c < self.columns) & (r >= 0) & (r < self.rows)
        return F.when(inside, self.cell_id(c, r)).otherwise(F.lit(-1))

    def ranges(self, r: Rect) -> tuple[Column, Column, Column, Column]:
        """First and last column, first and last row that the rectangle overlaps, clamped. A rectangle without extent has one cell."""
        a, b, c, d = r.cols()
        c1, r1 = self.column_of(a), self.row_of(b)
        c2 = F.greatest(c1, F.ceil((c - self.x1) / self.cell_width) - 1)
        r2 = F.greatest(r1, F.ceil((d - self.y1) / self.cell_height) - 1)
        return self.clamp_column(c1), self.clamp_column(c2), self.clamp_row(r1), self.clamp_row(r2)

    def cells_of_rect(self, r: Rect) -> Column:
        """Array of the ids of the cells that the rectangle overlaps."""
        c1, c2, r1, r2 = self.ranges(r)
        rows = F.transform(F.sequence(r1, r2), lambda row: F.transform(F.sequence(c1, c2), lambda col: self.cell_id(col, row)))
        return F.flatten(rows)
