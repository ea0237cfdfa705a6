"""Delaunay triangulation and Voronoi regions over distributed points.

Points are cut into cells; each is triangulated in its own task. Triangles whose circumcircle lies in the cell are final. Sites with any
other triangle, those near a cell's border, go on to blocks of ``MERGED`` by ``MERGED`` cells, where they are triangulated together; of that result the triangles outside
the final ones are added, those whose circumcircle lies in the block are final in turn, and so on with larger blocks. A block's task has the
sites along the borders of its parts only, so it grows with the root of the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.kernel import delaunay as D
from stratum.operators.select import dedup_points
from stratum.scratch import Scratch

#: Cells a side that are merged at once.
MERGED = 4
TRIANGLE = "ax double, ay double, bx double, by double, cx double, cy double"


def delaunay(df: DataFrame, tolerance: float = 0.0, cell_points: int = 5_000) -> DataFrame:
    """(ax, ay, bx, by, cx, cy): counter-clockwise, from the least (x, y). Equal points are one; all points on a line give none."""
    scratch = Scratch(df.sparkSession, "delaunay")
    base = df.where("x IS NOT NULL AND y IS NOT NULL")
    pts = (dedup_points(base, tolerance) if tolerance > 0 else base.dropDuplicates(["x", "y"])).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pts = scratch.save(pts, "points")
    n, x1, y1, x2, y2 = pts.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = max(1, math.ceil(math.sqrt((n or 0) / cell_points)))
    w, h = ((x2 - x1) / side or 1.0, (y2 - y1) / side or 1.0) if n else (1.0, 1.0)
    col = lambda v, low, size: F.least(F.floor((F.col(v) - low) / size), F.lit(side - 1)).cast("int")
    celled = pts.withColumns({"i": col("x", x1 or 0.0, w), "j": col("y", y1 or 0.0, h)})

    def local(key, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        p = rows[["x", "y"]].to_numpy(float)
        # The outermost cells reach beyond the data: nothing lies there.
        low = lambda k, origin, size: -np.inf if k == 0 else origin + k * size
        high = lambda k, origin, size: np.inf if k == side - 1 else origin + (k + 1) * size
        safe, rest = D.split_safe(p, D.triangulate(p), (low(i, x1, w), low(j, y1, h), high(i, x1, w), high(j, y1, h)))
        out = [(0, *p[a], *p[b], *p[c]) for a, b, c in safe]
        out += [(1, *p[k], 0.0, 0.0, 0.0, 0.0) for k in sorted(rest)]
        edges = {e: True for t in safe for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        out += [(2, *p[u], *p[v], 0.0, 0.0) for u, v in edges if (v, u) not in edges]
        return pd.DataFrame(out, columns=["kind", "ax", "ay", "bx", "by", "cx", "cy"]).assign(i=i, j=j)

    parts = scratch.save(celled.groupBy("i", "j").applyInPandas(local, f"kind int, {TRIANGLE}, i int, j int"), "parts")

    def block(of: int):
        """Merges what is left of blocks of ``of`` cells a side."""

        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            i, j = key
            p = rows[rows.kind == 1][["ax", "ay"]].drop_duplicates().to_numpy(float)
            at = {tuple(v): k for k, v in enumerate(p.tolist())}
            borders = [(at[a, b], at[c, d]) for a, b, c, d in rows[rows.kind == 2][["ax", "ay", "bx", "by"]].to_numpy(float).tolist() if (a, b) in at and (c, d) in at]
            low = lambda k, origin, size: -np.inf if k == 0 else origin + k * of * size
            high = lambda k, origin, size: np.inf if (k + 1) * of >= side else origin + (k + 1) * of * size
            safe, left, edges = D.settle(p, borders, (low(i, x1, w), low(j, y1, h), high(i, x1, w), high(j, y1, h))) if len(p) else ([], (), [])
            out = [(0, *p[a], *p[b], *p[c]) for a, b, c in safe]
            out += [(1, *p[k], 0.0, 0.0, 0.0, 0.0) for k in sorted(left)]
            out += [(2, *p[u], *p[v], 0.0, 0.0) for u, v in edges]
            return pd.DataFrame(out, columns=["kind", "ax", "ay", "bx", "by", "cx", "cy"]).assign(i=i, j=j)

        return run

    every, of = parts.where("kind = 0").drop("kind", "i", "j"), 1
    while parts.where("kind = 1").limit(1).count():
        of *= MERGED
        up = parts.where("kind > 0").withColumns({c: F.floor(F.col(c) / MERGED).cast("int") for c in ("i", "j")})
        parts = scratch.save(up.groupBy("i", "j").applyInPandas(block(of), f"kind int, {TRIANGLE}, i int, j int"), f"parts{of}")
        every = every.unionByName(parts.where("kind = 0").drop("kind", "i", "j"))
    c = [F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "abc"]
    turns = F.array(F.array(c[0], c[1], c[2]), F.array(c[1], c[2], c[0]), F.array(c[2], c[0], c[1]))
    t = F.array_min(turns)
    return every.select(*[t[i][v].alias(f"{k}{v}") for i, k in enumerate("abc") for v in "xy"])


def voronoi(triangles: DataFrame) -> DataFrame:
    """(x, y, closed, ring): of each site the circumcentres of its triangles in angular order; ``closed`` if they go all around, else an open line."""
    corners = triangles.select(*[F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")).alias(k) for k in "abc"])
    site = corners.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("b").alias("s"), F.col("c").alias("p"), F.col("a").alias("q")), F.struct(F.col("c").alias("s"), F.col("a").alias("p"), F.col("b").alias("q")))).alias("t")).select("t.*")
    bx, by = F.col("p.x") - F.col("s.x"), F.col("p.y") - F.col("s.y")
    cx, cy = F.col("q.x") - F.col("s.x"), F.col("q.y") - F.col("s.y")
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    fan = site.select("s", "p", "q", F.atan2(by, bx).alias("angle"), (F.col("s.x") + ux).alias("ox"), (F.col("s.y") + uy).alias("oy"))
    # A site's number of triangles is small (six on average), so its list is too.
    grouped = fan.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("angle", "p", "q", "ox", "oy"))).alias("f"))
    firsts, seconds = F.transform("f", lambda x: x["p"]), F.transform("f", lambda x: x["q"])
    closed = F.size(F.array_except(firsts, seconds)) == 0
    # An open fan starts at the triangle whose first neighbour ends no other.
    start = F.coalesce(F.get(F.filter(F.transform("f", lambda x, i: F.when(F.exists("f", lambda o: o["q"] == x["p"]), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    turned = grouped.withColumns({"closed": closed, "start": start}).withColumn("f", F.concat(F.slice("f", F.col("start") + 1, F.size("f")), F.slice("f", F.lit(1), F.col("start"))))
    return turned.select("s.x", "s.y", "closed", F.transform("f", lambda x: F.struct(x["ox"].alias("x"), x["oy"].alias("y"))).alias("ring"))
