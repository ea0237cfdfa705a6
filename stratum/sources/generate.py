"""Random shapes, the same for a seed whatever the number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: correlation of the correlated and anti-correlated distributions.
RHO = 0.9


def _uniform(seed: int, k: int) -> Column:
    """In [0, 1), from a hash of the row's number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), 11) / float(1 << 53)


def _normal(seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.log(1 - _uniform(seed, k))) * F.cos(2 * math.pi * _uniform(seed, k + 1))


def generate(spark: SparkSession, n: int, box: tuple = (0.0, 0.0, 1e6, 1e6), distribution: str = "uniform", seed: int = 1, rect_size: float = 0.0, thickness: float = 1.0) -> DataFrame:
    """(id, x, y), or rectangles with sides from 2 to ``rect_size`` + 1 if that is given. ``distribution``: uniform, gaussian,
    correlated, anticorrelated, circle (a ring of relative ``thickness``). All shapes start within the box."""
    x1, y1, x2, y2 = box
    u, v = _uniform(seed, 1), _uniform(seed, 2)
    if distribution == "gaussian":
        u, v = _normal(seed, 1) * 0.1 + 0.5, _normal(seed, 3) * 0.1 + 0.5
    elif distribution in ("correlated", "anticorrelated"):
        a, b = _normal(seed, 1), _normal(seed, 3)
        c = RHO * a + math.sqrt(1 - RHO * RHO) * b
        u, v = a * 0.1 + 0.5, (c if distribution == "correlated" else -c) * 0.1 + 0.5
    elif distribution == "circle":
        angle, r = 2 * math.pi * u, 0.5 * (1 - thickness * 0.1 * v)
        u, v = 0.5 + r * F.cos(angle), 0.5 + r * F.sin(angle)
    elif distribution != "uniform":
        raise ValueError(f"unknown distribution {distribution!r}")
    unit = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1 - 1e-12))
    pts = spark.range(n).select("id", (x1 + unit(u) * (x2 - x1)).alias("x"), (y1 + unit(v) * (y2 - y1)).alias("y"))
    if not rect_size:
        return pts
    side = lambda k: F.floor(_uniform(seed, k) * rect_size) + 2
    return pts.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + side(7)).alias("x2"), (F.col("y") + side(8)).alias("y2"))
