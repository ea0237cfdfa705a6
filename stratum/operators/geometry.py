"""Exact geometry: range queries, joins and refinement by true shapes, after the tests on rectangles.

Rows have ``geom`` (WKB) and the rectangle x1, y1, x2, y2 around it (:func:`with_boxes`). The rectangle tests are plain comparisons in the JVM and
decide nearly everything; exact predicates come in Arrow batches for the rows that are left. Null and empty geometries meet nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from stratum.functions import rects as R
from stratum.kernel import plain, shapes as S
from stratum.operators.joins import spatial_join
from stratum.scratch import Scratch

_BOX = StructType([StructField(c, DoubleType()) for c in R.BOX])
_DIAGONALS = StructType([StructField(c, DoubleType()) for c in ("u1", "v1", "u2", "v2")])


@F.pandas_udf(BinaryType())
def from_wkt(text: pd.Series) -> pd.Series:
    """WKB of WKT; null for what is no geometry."""
    return text.map(lambda t: None if t is None else plain.wkb_of(t) or (S.to_wkb(g) if (g := S.parse_geometry(t)) is not None else None))


def _each(data: pd.Series, many, one, out: np.ndarray) -> np.ndarray:
    """``out`` filled by ``many`` for the plain polygons of a batch (None: not these), by ``one`` for each other geometry; nulls keep what is there."""
    items = data.tolist()
    rest = np.array([b is not None for b in items], bool)
    for at, c in plain.rings(items):
        if len(at) and (v := many(c)) is not None:
            out[at] = v
            rest[at] = False
    for i in np.flatnonzero(rest):
        if (v := one(S.parse_wkb(bytes(items[i])))) is not None:
            out[i] = v
    return out


@F.pandas_udf(StringType())
def to_wkt(data: pd.Series) -> pd.Series:
    return pd.Series(_each(data, plain.texts, S.to_wkt, np.full(len(data), None, object)), dtype=object)


@F.pandas_udf(_BOX)
def envelope(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each(data, lambda c: np.hstack([c.min(axis=1), c.max(axis=1)]), S.envelope, np.full((len(data), 4), np.nan)), columns=list(R.BOX))


def _turned(g: tuple) -> tuple:
    """Points (x, y) as (x + y, x - y)."""
    turn = lambda c: [turn(x) for x in c] if c and isinstance(c[0], (list, tuple)) else (c[0] + c[1], c[0] - c[1]) if c else c
    return (g[0], [_turned(x) for x in g[1]]) if g[0] == "GEOMETRYCOLLECTION" else (g[0], turn(g[1]))


@F.pandas_udf(_DIAGONALS)
def diagonals(data: pd.Series) -> pd.DataFrame:
    """Ends of x + y and of x - y: the rectangle around the geometry turned by 45 degrees."""

    def many(c: np.ndarray) -> np.ndarray:
        u, v = c[..., 0] + c[..., 1], c[..., 0] - c[..., 1]
        return np.stack([u.min(axis=1), v.min(axis=1), u.max(axis=1), v.max(axis=1)], axis=1)

    return pd.DataFrame(_each(data, many, lambda g: S.envelope(_turned(g)), np.full((len(data), 4), np.nan)), columns=["u1", "v1", "u2", "v2"])


@F.pandas_udf(BooleanType())
def meets(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two geometries have a point in common. Plain polygons are tested together; of the others each different one of a batch is parsed once."""
    seen: dict[bytes, tuple] = {}

    def parsed(x):
        x = bytes(x)
        if x not in seen:
            seen[x] = S.parse_wkb(x)
        return seen[x]

    left, right = a.tolist(), b.tolist()
    out, rest = np.zeros(len(left), bool), np.array([x is not None and y is not None for x, y in zip(left, right)], bool)
    others = list(plain.rings(right))
    for at, c in plain.rings(left):
        for bt, d in others:
            _, i, j = np.intersect1d(at, bt, assume_unique=True, return_indices=True)
            out[at[i]] = plain.meet(c[i], d[j])
            rest[at[i]] = False
    for i in np.flatnonzero(rest):
        out[i] = S.intersects(parsed(left[i]), parsed(right[i]))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def area(data: pd.Series) -> pd.Series:
    return pd.Series(_each(data, plain.areas, lambda g: float(S.area(g)), np.full(len(data), np.nan)))


def simplified(tolerance: float):
    """A function of a WKB column: lines and rings with fewer corners, none further than ``tolerance`` from the old course. Rings keep three corners."""

    def ring(points: list) -> list:
        out = S.simplify(points, tolerance)
        return out if len(out) > 3 else points

    def one(g: tuple) -> tuple:
        if g[0] == "LINESTRING":
            return g[0], S.simplify(g[1], tolerance)
        return (g[0], [ring(x) for x in g[1]]) if g[0] == "POLYGON" else g

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else S.to_wkb(one(S.parse_wkb(bytes(b)))))

    return run


def exit_point(box: R.Rect, inside: tuple, outside: tuple) -> Column:
    """Struct (x, y) where the segment from a point of a rectangle to one beyond leaves it; null if it doesn't."""
    a, b, c, d = box.cols()
    (px, py), (qx, qy) = inside, outside
    dx, dy = qx - px, qy - py
    at = lambda delta, p, low, high: F.when(delta > 0, (high - p) / delta).when(delta < 0, (low - p) / delta)
    t = F.least(at(dx, px, a, c), at(dy, py, b, d))
    return F.when((t >= 0) & (t <= 1), F.struct((px + t * dx).alias("x"), (py + t * dy).alias("y")))


def with_boxes(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumn("_e", envelope(F.col(geom))).withColumns({c: F.col(f"_e.{c}") for c in R.BOX}).drop("_e")


def range_geometries(df: DataFrame, query: tuple) -> DataFrame:
    """The rows whose geometry meets ``query``, a parsed geometry (:func:`stratum.kernel.shapes.parse_geometry`)."""
    e = S.envelope(query)
    if e is None:
        return df.limit(0)
    return df.where(R.touches(R.rect(), R.Rect(*e))).where(meets(F.col("geom"), F.lit(S.to_wkb(query))))


def join_geometries(left: DataFrame, right: DataFrame, keep_left: list[str], keep_right: list[str], filter_only: bool = False, **options) -> DataFrame:
    """Pairs of rows whose geometries meet; ``filter_only`` stops after the rectangles, of which only common interiors count. The grid join counts common interiors,
    so for exact tests all rectangles are widened by the least amount, for ``filter_only`` those without extent. Rectangles turned by 45 degrees
    part most pairs in the JVM that upright ones don't."""
    scratch = Scratch(left.sparkSession, "geometries")
    sides = []
    for df, keep, name in ((left, keep_left, "l"), (right, keep_right, "r")):
        # The join reads its sides several times; geometries are made once.
        cols = dict.fromkeys([*keep, *R.BOX])
        if filter_only:
            df = scratch.save(df.select(*cols), name)
        else:
            df = scratch.save(df.select(*dict.fromkeys([*cols, "geom"]), diagonals(F.col("geom")).alias("_d")), name).select("*", "_d.*").drop("_d")
        sides.append(df.withColumns({high: F.when((F.col(high) > F.col(low)) & F.lit(filter_only), F.col(high)).otherwise(F.col(high) + F.abs(high) * 1e-15 + 1e-300) for low, high in (("x1", "x2"), ("y1", "y2"))}))
    if filter_only:
        return spatial_join(*sides, keep_left, keep_right, **options)
    more = ["geom", "u1", "v1", "u2", "v2"]
    turned = R.touches(R.Rect(*[f"l_{c}" for c in more[1:]]), R.Rect(*[f"r_{c}" for c in more[1:]]))
    refine = options.pop("refine", None)
    met = spatial_join(*sides, list(dict.fromkeys([*keep_left, *more])), list(dict.fromkeys([*keep_right, *more])), turned if refine is None else turned & refine, **options)
    return met.where(meets(F.col("l_geom"), F.col("r_geom"))).select(*[f"l_{c}" for c in keep_left], *[f"r_{c}" for c in keep_right])


# Pixels of lines and polygons.


def plot_segments(df: DataFrame, box: tuple, width: int, height: int) -> DataFrame:
    """(px, py, value) of segments (x1, y1) to (x2, y2): one pixel for each step along the longer side, y downwards; steps outside the image go."""
    col = lambda c: (F.col(c) - box[0]) / (box[2] - box[0]) * width
    row = lambda c: (F.col(c) - box[1]) / (box[3] - box[1]) * height
    s = df.select(col("x1").alias("a"), row("y1").alias("b"), col("x2").alias("c"), row("y2").alias("d"))
    s = s.withColumn("n", F.greatest(F.ceil(F.greatest(F.abs(F.col("c") - F.col("a")), F.abs(F.col("d") - F.col("b")))), F.lit(1)))
    s = s.where((F.greatest("a", "c") >= 0) & (F.least("a", "c") <= width) & (F.greatest("b", "d") >= 0) & (F.least("b", "d") <= height))
    steps = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))
    px, py = F.floor(F.col("a") + (F.col("c") - F.col("a")) * F.col("k") / F.col("n")), F.floor(F.col("b") + (F.col("d") - F.col("b")) * F.col("k") / F.col("n"))
    at = steps.select(px.cast("int").alias("px"), (height - 1 - py).cast("int").alias("py")).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    return at.groupBy("px", "py").agg(F.count("*").alias("value"))


def plot_polygons(df: DataFrame, box: tuple, width: int, height: int) -> DataFrame:
    """(px, py, value): how many geometries cover the middle of a pixel. Scan lines are exploded first, so a large polygon is spread over rows;
    each row then finds its runs of pixels from the crossings of its line with the edges (even-odd)."""
    sx, sy = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    rows = df.where(R.touches(R.rect(), R.Rect(*box))).withColumns({"r1": F.greatest(F.ceil((F.col("y1") - box[1]) / sy - 0.5), F.lit(0)), "r2": F.least(F.floor((F.col("y2") - box[1]) / sy - 0.5), F.lit(height - 1))})
    lines = rows.where("r1 <= r2").select("geom", F.explode(F.sequence("r1", "r2")).alias("r"))

    @F.pandas_udf("array<array<int>>")
    def runs(geom: pd.Series, r: pd.Series) -> pd.Series:
        seen: dict[bytes, list] = {}
        out = []
        for data, k in zip(geom, r):
            data = bytes(data)
            if data not in seen:
                seen[data] = [e for g in S.flatten(S.parse_wkb(data)) if g[0] == "POLYGON" for ring in g[1] for e in zip(ring, ring[1:])]
            y = box[1] + (k + 0.5) * sy
            xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in seen[data] if (a[1] <= y) != (b[1] <= y))
            spans = [[max(0, int(-(-((lo - box[0]) / sx - 0.5) // 1))), min(width - 1, int(((hi - box[0]) / sx - 0.5) // 1))] for lo, hi in zip(xs[::2], xs[1::2])]
            out.append([s for s in spans if s[0] <= s[1]])
        return pd.Series(out)

    spans = lines.select("r", F.explode(runs("geom", "r")).alias("s"))
    return spans.select(F.explode(F.sequence(F.get("s", F.lit(0)), F.get("s", F.lit(1)))).alias("px"), (height - 1 - F.col("r")).cast("int").alias("py")).groupBy("px", "py").agg(F.count("*").alias("value"))
