"""Spatial joins: pairs of rows whose rectangles overlap (or a rectangle and a point in it).

Both sides are replicated to the cells of a grid that they overlap, joined on the cell, tested, and a pair
is kept only in the cell of its reference point, so no distinct is needed. Cells come from the sizes of
the rectangles and the number of rows. The grid has levels, each with cells four times as wide: a row lives on
the level whose cells are about its size, and also goes to those coarser levels on which the other side has rows
of its own. A pair meets on the coarser of its two levels. So one huge rectangle costs a few rows, not one
for each cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import rects as R
from stratum.scratch import is_small

#: A side of at most so many rows is broadcast whole: a nested loop over it, without cells.
BROADCAST_ROWS = 1_000
LEVEL_STEP = 4


def boxed(df: DataFrame) -> DataFrame:
    """Points as rectangles without extent."""
    if "x1" in df.columns:
        return df
    return df.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})


def _sides(df: DataFrame, prefix: str, keep: list[str] | None) -> tuple[DataFrame, bool]:
    point = "x1" not in df.columns
    cols = list(dict.fromkeys([*(keep or df.columns), *(("x", "y") if point else R.BOX)]))
    named = df.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])
    if point:
        named = named.withColumns({f"{prefix}{c}": F.col(f"{prefix}{c[0]}") for c in R.BOX})
    return named.where(F.col(f"{prefix}x1").isNotNull() & F.col(f"{prefix}y1").isNotNull()), point


def _test(left_point: bool, right_point: bool, refine: Column | None) -> Column:
    a, b = R.rect("l_"), R.rect("r_")
    if left_point and right_point:
        test = (F.col("l_x1") == F.col("r_x1")) & (F.col("l_y1") == F.col("r_y1"))
    elif left_point:
        test = R.has_point(b, "l_x1", "l_y1")
    elif right_point:
        test = R.has_point(a, "r_x1", "r_y1")
    else:
        test = R.meets(a, b)
    return test if refine is None else test & refine


def choose_cell(left: DataFrame, right: DataFrame) -> tuple[float, float, float]:
    """(x0, y0, side) of the finest cells: the side is that of the typical rectangle, or of all if none is twice as large, or of a cell with a few rows, if that is larger."""
    stats = []
    for df, p in ((left, "l_"), (right, "r_")):
        w, h = F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")
        stats.append(df.agg(F.count("*"), F.min(f"{p}x1"), F.min(f"{p}y1"), F.max(f"{p}x2"), F.max(f"{p}y2"), F.percentile_approx(F.greatest(w, h), 0.5, 1000), F.max(F.greatest(w, h))).first())
    stats = [s for s in stats if s[0]]
    if not stats:
        return 0.0, 0.0, 1.0
    x1, y1 = min(s[1] for s in stats), min(s[2] for s in stats)
    x2, y2 = max(s[3] for s in stats), max(s[4] for s in stats)
    rows = max(s[0] for s in stats)
    side = max(max(min(2 * s[5], s[6]) for s in stats), math.sqrt(max((x2 - x1) * (y2 - y1), 1e-12) / max(rows, 1)) * 2)
    return x1, y1, side if side > 0 else 1.0


def spatial_join(left: DataFrame, right: DataFrame, keep_left: list[str] | None = None, keep_right: list[str] | None = None, refine: Column | None = None, strategy: str = "auto", cell: tuple[float, float, float] | None = None, levels: int = 6) -> DataFrame:
    """Columns of the left side as l_<name>... and of the right as r_<name>, or those kept; l_id alone if ``keep_left`` is ["id"].

    ``refine``: a further condition over l_ and r_ columns. ``strategy``: "grid", "broadcast" or "auto", which broadcasts a side of
    at most ``BROADCAST_ROWS`` rows. ``levels``: of the grid; the last takes all larger rectangles.
    """
    a, left_point = _sides(left, "l_", keep_left)
    b, right_point = _sides(right, "r_", keep_right)
    out = [f"l_{c}" for c in keep_left or left.columns] + [f"r_{c}" for c in keep_right or right.columns]
    test = _test(left_point, right_point, refine)
    if strategy == "auto":
        strategy = "broadcast" if is_small(b, BROADCAST_ROWS) or is_small(a, BROADCAST_ROWS) else "grid"
    if strategy == "broadcast":
        small_right = is_small(b, BROADCAST_ROWS)
        return a.join(F.broadcast(b), test).select(*out) if small_right else b.join(F.broadcast(a), test).select(*out)
    x0, y0, side = cell or choose_cell(a, b)

    def width(level: Column) -> Column:
        return F.lit(side) * F.pow(F.lit(float(LEVEL_STEP)), level)

    def at(v: Column, low: float, width: Column) -> Column:
        return F.floor((v - low) / width).cast("long")

    def level_of(p: str) -> Column:
        extent = F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
        level = F.greatest(F.ceil(F.log(F.greatest(extent / side, F.lit(1e-9))) / math.log(LEVEL_STEP)), F.lit(0))
        return F.least(level, F.lit(levels - 1)).cast("int")

    def cells(df: DataFrame, p: str, width: Column) -> DataFrame:
        """A row for each cell of a level that the rectangle touches; the same rounding as for the reference point."""
        x1, y1, x2, y2 = (F.col(f"{p}{c}") for c in R.BOX)
        df = df.withColumn(f"{p}cx", F.explode(F.sequence(at(x1, x0, width), at(x2, x0, width))))
        return df.withColumn(f"{p}cy", F.explode(F.sequence(at(y1, y0, width), at(y2, y0, width))))

    # A pair meets on the coarser of its rows' levels: each row goes to its own level and up to all coarser ones.
    def spread(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumn(f"{p}own", level_of(p))
        df = df.withColumn(f"{p}level", F.explode(F.sequence(F.col(f"{p}own"), F.lit(levels - 1))))
        return cells(df.withColumn(f"{p}width", width(F.col(f"{p}level"))), p, F.col(f"{p}width"))

    a, b = _with_levels(spread(a, "l_"), "l_", level_of, b, "r_"), _with_levels(spread(b, "r_"), "r_", level_of, a, "l_")
    px, py = R.reference_point(R.rect("l_"), R.rect("r_"))
    same = (F.col("l_level") == F.col("r_level")) & (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy"))
    once = (F.col("l_level") == F.greatest("l_own", "r_own")) & (at(px, x0, F.col("l_width")) == F.col("l_cx")) & (at(py, y0, F.col("l_width")) == F.col("l_cy"))
    return a.join(b, same & test & once).select(*out)


def _with_levels(spread: DataFrame, p: str, level_of, other: DataFrame, q: str) -> DataFrame:
    """Drops levels on which the other side has no row of its own, and that aren't the row's own."""
    present = [r[0] for r in other.select(level_of(q)).distinct().collect()]  # a few levels
    return spread.where((F.col(f"{p}level") == F.col(f"{p}own")) | F.col(f"{p}level").isin(present or [-1]))


def self_join(df: DataFrame, key: str = "id", keep: list[str] | None = None, unordered: bool = False, **options) -> DataFrame:
    """Pairs of different rows, in both orders or (``unordered``) once, the smaller key left."""
    different = F.col(f"l_{key}") < F.col(f"r_{key}") if unordered else F.col(f"l_{key}") != F.col(f"r_{key}")
    more = options.pop("refine", None)
    return spatial_join(df, df, keep or [key], keep or [key], different if more is None else different & more, **options)


def partition_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_cell_id, r_cell_id) of overlapping partitions of two indexes, from their metadata."""
    cols = ("cell_id", *R.BOX)
    return spatial_join(left.select(*cols), right.select(*cols), ["cell_id"], ["cell_id"])


def lookup_join(df: DataFrame, categories: DataFrame, on: str, rows: int = 100_000) -> DataFrame:
    """Adds the columns of a lookup table; broadcast if it has at most ``rows`` rows."""
    return df.join(F.broadcast(categories) if is_small(categories, rows) else categories, on)
