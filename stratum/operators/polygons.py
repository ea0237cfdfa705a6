"""Unions of polygons: connected groups, per category, and the lines of their boundaries.

Geometries are binary (WKB). Polygons are joined by overlap of their rectangles, groups follow by label propagation over
the pairs, and each group is united; large groups are united in two steps, by grid cell of their centres first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import rects as R
from stratum.kernel import overlay, shapes as S
from stratum.operators import geometry
from stratum.operators.joins import self_join
from stratum.scratch import Scratch, spread

BATCH = 500


def with_boxes(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Adds the rectangle of each geometry; rows without one go."""
    return df.withColumn("_e", geometry.envelope(F.col(geom))).select(*[c for c in df.columns if c not in R.BOX], "_e.*").where("x1 IS NOT NULL")


def _united(key_schema: str, keys: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [S.parse_wkb(bytes(g)) for g in rows["geom"]]
        while len(parts) > BATCH:
            parts = [overlay.union(parts[i : i + BATCH]) for i in range(0, len(parts), BATCH)]
        out = rows[keys].iloc[:1].copy()
        out["geom"] = [S.to_wkb(overlay.union(parts))]
        return out

    return run, f"{key_schema}, geom binary"


def groups(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, label): the least id of the polygons connected by overlapping rectangles."""
    scratch = Scratch(df.sparkSession, "groups")
    pairs = scratch.save(self_join(df.select(key, *R.BOX), key).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b")), "pairs")
    labels = scratch.save(df.select(F.col(key).alias("id"), F.col(key).alias("label")), "labels0")
    for k in range(1, 100):
        near = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        low = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("least", "label")).alias("label"), F.col("label").alias("was"))
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = scratch.save(low.join(jump, "label").select("id", F.least("label", "up").alias("label"), "was"), f"labels{k}")
        labels = step.select("id", "label")
        if step.where("label <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("groups did not settle")


def union(df: DataFrame, key: str = "id", cell: float | None = None) -> DataFrame:
    """(label, geom): one geometry for each connected group of polygons."""
    b = Scratch(df.sparkSession, "union").save(with_boxes(df), "boxes")  # read by each step of the groups
    placed = b.join(groups(b, key).withColumnRenamed("id", key), key)
    if cell:
        x, y = R.centre(R.rect())
        run, schema = _united("label long, cx long, cy long", ["label", "cx", "cy"])
        placed = placed.select("label", F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"), "geom").transform(spread, "label", "cx", "cy").groupBy("label", "cx", "cy").applyInPandas(run, schema)
    run, schema = _united("label long", ["label"])
    return spread(placed.select("label", "geom"), "label").groupBy("label").applyInPandas(run, schema)


def union_by(df: DataFrame, category: str) -> DataFrame:
    """(category, geom): one geometry per category."""
    kind = df.schema[category].dataType.simpleString()
    run, schema = _united(f"`{category}` {kind}", [category])
    return spread(df.where("geom IS NOT NULL").select(category, "geom"), category).groupBy(category).applyInPandas(run, schema)


def union_boundaries(df: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """(cx, cy, x1, y1, x2, y2): the boundary lines of the union of all polygons, clipped to cells: each cell unites the polygons that touch it."""
    b = with_boxes(df)
    f = lambda c: F.floor(F.col(c) / cell).cast("long")
    placed = b.select("geom", F.explode(F.sequence(f("x1"), f("x2"))).alias("cx"), f("y1").alias("r1"), f("y2").alias("r2")).select("geom", "cx", F.explode(F.sequence("r1", "r2")).alias("cy"))

    def lines(key, rows: pd.DataFrame) -> pd.DataFrame:
        cx, cy = key
        box = (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
        out = []
        for part in S.flatten(overlay.union([S.parse_wkb(bytes(g)) for g in rows["geom"]])):
            for ring in part[1]:
                out += [(cx, cy, *c) for a, q in zip(ring, ring[1:]) if (c := clip(a, q, box))]
        return pd.DataFrame(out, columns=["cx", "cy", "x1", "y1", "x2", "y2"])

    return spread(placed, "cx", "cy").groupBy("cx", "cy").applyInPandas(lines, "cx long, cy long, x1 double, y1 double, x2 double, y2 double")


def clip(a: tuple, b: tuple, box: tuple) -> tuple | None:
    """The part of a segment in a half-open box; None if it has no length."""
    t0, t1, dx, dy = 0.0, 1.0, b[0] - a[0], b[1] - a[1]
    for p, q in ((-dx, a[0] - box[0]), (dx, box[2] - a[0]), (-dy, a[1] - box[1]), (dy, box[3] - a[1])):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    if t0 >= t1 or dx == 0 and a[0] >= box[2] or dy == 0 and a[1] >= box[3]:
        return None
    return a[0] + t0 * dx, a[1] + t0 * dy, a[0] + t1 * dx, a[1] + t1 * dy
