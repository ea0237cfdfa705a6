"""Skyline, convex hull, closest and farthest pair.

Each reduces its input within tasks first; what is left is small for the data that these operators make sense on (a skyline,
the corners of a hull) and is finished by one window or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import rects as R
from stratum.kernel import hull as H

#: Buckets of the skyline's first pass.
SKYLINE_BUCKETS = 4096


def skyline(df: DataFrame, direction: str = "max-max") -> DataFrame:
    """Points (x, y) that no other one dominates; equal points are one. ``direction``: max or min for x, then y.

    Within a task only points that aren't dominated there stay (``mapInPandas``). Then x is cut into ranges: a point
    stays if it is above the best y of all ranges further out (from a table of a row per range) and of all points further out in its
    own range. No range is gathered in one task with another.
    """
    sx, sy = (1 if d == "max" else -1 for d in direction.split("-"))
    signed = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select((F.col("x") * sx).alias("x"), (F.col("y") * sy).alias("y"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = H.skyline(np.vstack([kept, b[["x", "y"]].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    few = signed.mapInPandas(local, "x double, y double")
    bounds = few.agg(F.min("x"), F.max("x")).first()
    if bounds[0] is None:
        return few
    extent = bounds[1] - bounds[0] or 1.0
    bucket = F.least(F.floor((F.col("x") - bounds[0]) / extent * SKYLINE_BUCKETS), F.lit(SKYLINE_BUCKETS - 1)).cast("int")
    cut = few.withColumn("bucket", bucket)
    best = cut.groupBy("bucket").agg(F.max("y").alias("top"))
    beyond = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most SKYLINE_BUCKETS rows
    outer = best.select("bucket", F.max("top").over(beyond).alias("outer"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("x"), F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.max("y").over(inside), F.col("outer"))
    left = cut.join(F.broadcast(outer), "bucket").withColumn("ahead", ahead).where(F.col("ahead").isNull() | (F.col("y") > F.col("ahead")))
    return left.select((F.col("x") * sx).alias("x"), (F.col("y") * sy).alias("y"))


def convex_hull(df: DataFrame) -> DataFrame:
    """(position, x, y): corners counter-clockwise from the least (x, y); points on edges are no corners. One or two points are their own hull.

    Hulls of tasks, then hulls of groups of them until one is left.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = H.convex_hull(np.vstack([kept, b[["x", "y"]].dropna().to_numpy(float)]))
        yield pd.DataFrame({"position": np.arange(len(kept)), "x": kept[:, 0], "y": kept[:, 1]})

    schema = "position long, x double, y double"
    hulls = df.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(local, schema)
    middle = hulls.repartition(16).mapInPandas(local, schema)
    return middle.coalesce(1).mapInPandas(local, schema)


def farthest_pair(df: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2, distance), the lexicographically smaller point first; of equal distances the first pair. Both ends are corners of the hull."""
    corners = convex_hull(df)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pts = np.vstack([b[["x", "y"]].to_numpy(float) for b in batches] or [np.zeros((0, 2))])
        best = H.farthest(pts)
        yield pd.DataFrame([best] if best else [], columns=["x1", "y1", "x2", "y2", "distance"], dtype=float)

    return corners.mapInPandas(pair, "x1 double, y1 double, x2 double, y2 double, distance double")


def closest_pair(df: DataFrame, tie: str = "id", sample_rows: int = 2_000) -> DataFrame:
    """(id1, id2, distance), id1 < id2; of equal distances the least ids. Empty for fewer than two points.

    Any distance found bounds the answer and can be the side of square cells. The first bound comes from a sample; then neighbours by x
    within each cell give the next, until it is no less than half the side: from there on no cell can hold more than nine points, whatever
    their number and distribution. Candidates are points of one or of neighbouring cells. If duplicates make the bound 0, equal points are the answer.
    """
    pts = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(tie).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    probe = pts.orderBy(F.xxhash64("id")).limit(sample_rows).toPandas()  # sample_rows rows
    bound = H.closest_distance(probe[["x", "y"]].to_numpy(float))
    empty = pts.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias("distance")).limit(0)
    if bound is None:
        return empty
    while bound > 0:
        cells = [F.floor(F.col(c) / bound).cast("long") for c in ("x", "y")]
        near = Window.partitionBy(*cells).orderBy("x", "y")
        ahead = pts.select("x", "y", F.lead("x").over(near).alias("nx"), F.lead("y").over(near).alias("ny"))
        least = ahead.agg(F.min(R.distance("x", "y", "nx", "ny"))).first()[0]
        if least is None or least >= bound / 2:
            bound = bound if least is None else min(bound, least)
            break
        bound = least
    if bound == 0:
        least = pts.groupBy("x", "y").agg(F.min("id").alias("id1"), F.count("*").alias("n")).where("n > 1")
        second = pts.join(least, ["x", "y"]).where("id > id1").groupBy("id1").agg(F.min("id").alias("id2"))
        return second.select("id1", "id2", F.lit(0.0).alias("distance")).orderBy("id1", "id2").limit(1)
    side = bound * (1 + 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    a = pts.select(F.col("id").alias("id1"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    spread = pts.select(F.col("id").alias("id2"), "x", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"))
    b = spread.select("id2", "x", "y", (cell("x") + F.col("o.i")).alias("cx"), (cell("y") + F.col("o.j")).alias("cy"))
    pairs = a.join(b, ["cx", "cy"]).where("id1 < id2").select("id1", "id2", R.distance("ax", "ay", "x", "y").alias("distance"))
    return pairs.orderBy("distance", "id1", "id2").limit(1)
