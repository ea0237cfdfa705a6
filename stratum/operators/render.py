"""Images: shapes to pixels, heat maps, tile pyramids, and their writers.

Everything up to the pixel table is a plan (``explode`` and ``groupBy``); an image is densified only at the end, one
image or tile at a time. A plotter of the user is a function from rows to (px, py, value) columns.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import curves, rects as R
from stratum.functions.values import gradient
from stratum.operators.aggregates import histogram
from stratum.operators.joins import boxed
from stratum.operators.select import is_point

TILE = 256


def canvas_size(box: tuple, width: int = 1000, height: int = 1000, keep_ratio: bool = True) -> tuple[int, int]:
    w, h = box[2] - box[0], box[3] - box[1]
    if not keep_ratio or w <= 0 or h <= 0:
        return width, height
    return (width, max(1, round(width * h / w))) if w / h > width / height else (max(1, round(height * w / h)), height)


def _pixel(v: Column, low: float, high: float, n: int) -> Column:
    return F.floor((v - low) / ((high - low) or 1.0) * n)


def _clamped(v: Column, n: int) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")


def plot_points(df: DataFrame, box: tuple, width: int, height: int, value: Column | None = None) -> DataFrame:
    """(px, py, value): rows (or the sum of ``value``) per pixel, y downwards; points outside the box go, those on its upper edges count in the last pixels."""
    inside = df.where((F.col("x") >= box[0]) & (F.col("x") <= box[2]) & (F.col("y") >= box[1]) & (F.col("y") <= box[3]))
    px = _clamped(_pixel(F.col("x"), box[0], box[2], width), width)
    py = (height - 1 - _clamped(_pixel(F.col("y"), box[1], box[3], height), height)).cast("int")
    return inside.groupBy(px.alias("px"), py.alias("py")).agg((F.count("*") if value is None else F.sum(value)).alias("value"))


def plot_shapes(df: DataFrame, box: tuple, width: int, height: int, fill: bool = False) -> DataFrame:
    """As :func:`plot_points`, for rectangles: their outlines, or all pixels that they cover. Rectangles under a pixel are one pixel."""
    if is_point(df):
        return plot_points(df, box, width, height)
    b = df.where(R.touches(R.rect(), R.Rect(*box)))
    c1, c2 = (_clamped(_pixel(F.col(c), box[0], box[2], width), width) for c in ("x1", "x2"))
    r1, r2 = (_clamped(_pixel(F.col(c), box[1], box[3], height), height) for c in ("y1", "y2"))
    lines = b.select(c1.alias("c1"), c2.alias("c2"), r1.alias("r1"), r2.alias("r2")).select("*", F.explode(F.sequence("r1", "r2")).alias("r"))
    full = F.sequence("c1", "c2")
    edge = F.when((F.col("r") == F.col("r1")) | (F.col("r") == F.col("r2")), full).otherwise(F.array_distinct(F.array("c1", "c2")))
    cells = lines.select("r", F.explode(full if fill else edge).alias("px"))
    return cells.groupBy("px", (height - 1 - F.col("r")).cast("int").alias("py")).agg(F.count("*").alias("value"))


def kernel(radius: int = 5, smooth: bool = True, sigma: float = 8.0) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) from -radius to radius - 1: Gaussian over the whole square, or a flat disc."""
    out = []
    for dx in range(-radius, radius):
        for dy in range(-radius, radius):
            d2 = dx * dx + dy * dy
            if smooth:
                out.append((dx, dy, math.exp(-d2 / (2 * sigma))))
            elif d2 <= radius * radius:
                out.append((dx, dy, 1.0))
    return out


def heat_map(df: DataFrame, box: tuple, width: int, height: int, radius: int = 5, smooth: bool = True, sigma: float = 8.0) -> DataFrame:
    """(px, py, value): kernel-weighted counts. Points are counted per pixel first, so a crowded pixel spreads once."""
    counts = plot_points(df, box, width, height)
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel(radius, smooth, sigma)])
    spread = counts.select("px", "py", "value", F.explode(offsets).alias("k"))
    spread = spread.select((F.col("px") + F.col("k.dx")).alias("px"), (F.col("py") + F.col("k.dy")).alias("py"), (F.col("value") * F.col("k.w")).alias("value"))
    inside = spread.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    return inside.groupBy("px", "py").agg(F.sum("value").alias("value"))


def plot_raster(df: DataFrame, box: tuple, width: int, height: int) -> DataFrame:
    """(px, py, value): the mean of the values per pixel."""
    px, py = _clamped(_pixel(F.col("x"), box[0], box[2], width), width), (height - 1 - _clamped(_pixel(F.col("y"), box[1], box[3], height), height)).cast("int")
    return df.where(R.has_point(R.Rect(*box), "x", "y")).groupBy(px.alias("px"), py.alias("py")).agg(F.avg("value").alias("value"))


def squared(box: tuple) -> tuple:
    """The box made square around its centre: the space of a pyramid."""
    side = max(box[2] - box[0], box[3] - box[1]) or 1.0
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2


def pyramid(df: DataFrame, box: tuple, levels: range | int, tile: int = TILE) -> DataFrame:
    """(z, tx, ty, px, py, value) of points on levels 0..n-1 (or a range): one count per pixel of the deepest level, then each level from the one below."""
    zs = range(levels) if isinstance(levels, int) else levels
    x1, y1, x2, y2 = squared(box)
    n = tile << (len(zs) and zs[-1])
    gx, gy = _clamped(_pixel(F.col("x"), x1, x2, n), n), (n - 1 - _clamped(_pixel(F.col("y"), y1, y2, n), n)).cast("int")
    level = df.where(R.touches(R.rect(), R.Rect(*box)) if not is_point(df) else (F.col("x") >= x1) & (F.col("x") <= x2) & (F.col("y") >= y1) & (F.col("y") <= y2))
    level = level.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.count("*").alias("value"))
    out = None
    for z in reversed(zs):
        t = lambda c: F.floor(F.col(c) / tile).cast("int")
        one = level.select(F.lit(z).alias("z"), t("gx").alias("tx"), t("gy").alias("ty"), (F.col("gx") % tile).cast("int").alias("px"), (F.col("gy") % tile).cast("int").alias("py"), "value")
        out = one if out is None else out.unionByName(one)
        level = level.groupBy(F.floor(F.col("gx") / 2).cast("int").alias("gx"), F.floor(F.col("gy") / 2).cast("int").alias("gy")).agg(F.sum("value").alias("value"))
    return out


def tile_counts(df: DataFrame, box: tuple, levels: range | int) -> DataFrame:
    """(z, tx, ty, value): rows that touch each tile; rectangles count in all tiles that they touch."""
    zs = range(levels) if isinstance(levels, int) else levels
    x1, y1, x2, y2 = squared(box)
    b = boxed(df).withColumn("z", F.explode(F.array(*map(F.lit, zs))))
    n = F.pow(F.lit(2.0), F.col("z")).cast("long")
    at = lambda c, low, high: F.least(F.greatest(F.floor((F.col(c) - low) / (high - low) * n), F.lit(0)), n - 1)
    tiles = b.select("z", F.explode(F.sequence(at("x1", x1, x2), at("x2", x1, x2))).alias("tx"), at("y1", y1, y2).alias("r1"), at("y2", y1, y2).alias("r2"), n.alias("n"))
    tiles = tiles.select("z", "tx", F.explode(F.sequence("r1", "r2")).alias("row"), "n")
    return tiles.groupBy("z", "tx", (F.col("n") - 1 - F.col("row")).alias("ty")).agg(F.count("*").alias("value"))


def classify_tiles(df: DataFrame, box: tuple, levels: int, threshold: float, weight: Column | None = None) -> DataFrame:
    """(z, tx, ty, size, kind) of the tiles with data. A tile whose size passes the threshold is an image; of the others, those with an image
    above them are data tiles, the rest shallow (drawn from a data tile further up)."""
    x1, y1, x2, y2 = squared(box)
    n = 1 << (levels - 1)
    cells = histogram(df, R.Grid(x1, y1, x2, y2, n, n), weight)
    level = cells.select(F.col("cx").alias("tx"), (n - 1 - F.col("cy")).alias("ty"), F.col("value").alias("size"))
    out = None
    for z in reversed(range(levels)):
        one = level.select(F.lit(z).alias("z"), F.col("tx").cast("int"), F.col("ty").cast("int"), "size")
        out = one if out is None else out.unionByName(one)
        level = level.groupBy(F.floor(F.col("tx") / 2).alias("tx"), F.floor(F.col("ty") / 2).alias("ty")).agg(F.sum("size").alias("size"))
    above = out.select((F.col("z") + 1).alias("z"), F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("size").alias("up"))
    joined = out.alias("t").join(above.alias("u"), (F.col("t.z") == F.col("u.z")) & (F.floor(F.col("t.tx") / 2) == F.col("ux")) & (F.floor(F.col("t.ty") / 2) == F.col("uy")), "left")
    kind = F.when(F.col("t.size") > threshold, "image").when(F.col("up").isNull() | (F.col("up") > threshold), "data").otherwise("shallow")
    return joined.select("t.z", "t.tx", "t.ty", "t.size", kind.alias("kind"))


def sub_pyramid(box: tuple, levels: range, query: tuple) -> list[tuple[int, int, int, int, int]]:
    """(z, first column, first row, end column, end row) of the tiles of each level that a rectangle overlaps, clipped."""
    x1, y1, x2, y2 = box
    out = []
    for z in levels:
        n = 1 << z
        f = lambda v, low, high, up: min(n, max(0, (math.ceil if up else math.floor)((v - low) / (high - low) * n)))  # noqa: B023, E731
        out.append((z, f(query[0], x1, x2, False), f(query[1], y1, y2, False), f(query[2], x1, x2, True), f(query[3], y1, y2, True)))
    return out


def image(pixels: DataFrame, width: int, height: int, first: tuple = (0, 0, 255, 255), last: tuple = (255, 0, 0, 255), low: float | None = None, high: float | None = None, space: str = "hsb") -> np.ndarray:
    """The pixel table as an array height x width x 4; at most width * height rows come to the driver."""
    rows = pixels.select("px", "py", "value").toPandas()
    return paint(rows, width, height, first, last, low, high, space)


def paint(rows: pd.DataFrame, width: int, height: int, first=(0, 0, 255, 255), last=(255, 0, 0, 255), low=None, high=None, space="hsb") -> np.ndarray:
    out = np.zeros((height, width, 4), np.uint8)
    if len(rows):
        low = rows["value"].min() if low is None else low
        high = rows["value"].max() if high is None else high
        colours = {v: gradient(v, low, high, first, last, space) for v in rows["value"].unique()}
        for x, y, v in zip(rows["px"], rows["py"], rows["value"]):
            out[y, x] = colours[v]
    return out


def png(pixels: np.ndarray) -> bytes:
    """An array of height x width x 4 bytes as a PNG file."""
    h, w, _ = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tile_images(pixels: DataFrame, tile: int = TILE, low: float | None = None, high: float | None = None) -> DataFrame:
    """(name, content): tile-z-x-y.png for each tile of a pyramid; a tile is bounded, so each is painted in one task."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        z, x, y = key
        return pd.DataFrame({"name": [f"tile-{z}-{x}-{y}.png"], "content": [png(paint(rows, tile, tile, low=low, high=high))]})

    return pixels.groupBy("z", "tx", "ty").applyInPandas(one, "name string, content binary")


def svg(df: DataFrame, box: tuple, width: int, height: int, stroke: str = "black") -> DataFrame:
    """A column ``value`` of SVG elements for points and rectangles, y downwards; those under a pixel go."""
    sx, sy = width / ((box[2] - box[0]) or 1.0), height / ((box[3] - box[1]) or 1.0)
    if is_point(df):
        cells = plot_points(df, box, width, height)
        return cells.select(F.format_string(f'<circle cx="%d" cy="%d" r="1" fill="{stroke}"/>', "px", "py").alias("value"))
    w, h = R.width(R.rect()) * sx, R.height(R.rect()) * sy
    return df.where(w * h >= 1).select(F.format_string(f'<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="none" stroke="{stroke}"/>', (F.col("x1") - box[0]) * sx, (box[3] - F.col("y2")) * sy, w, h).alias("value"))


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared difference of the hues of two images, from 0 (alike) to 1."""

    def hue(m: np.ndarray) -> np.ndarray:
        r, g, c = (m[..., k].astype(float) for k in range(3))
        top, low = m[..., :3].max(axis=-1).astype(float), m[..., :3].min(axis=-1).astype(float)
        d = np.where(top > low, top - low, 1.0)
        h = np.where(top == r, (g - c) / d % 6, np.where(top == g, (c - r) / d + 2, (r - g) / d + 4))
        return np.where(top > low, h / 6, 0.0)

    d = np.abs(hue(a) - hue(b))
    return float((np.minimum(d, 1 - d) ** 2).mean() * 4)


def tile_id(df: DataFrame) -> DataFrame:
    """Adds ``tile``: z, tx, ty in one number."""
    return df.withColumn("tile", curves.tile_encode(F.col("z"), F.col("tx"), F.col("ty")))
