"""Range queries and nearest neighbours.

Points are rows with x, y; rectangles rows with x1, y1, x2, y2. Predicates are plain column comparisons, so they
reach the Parquet scan; exact tests on geometries come after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import rects as R
from stratum.scratch import Scratch


def is_point(df: DataFrame) -> bool:
    return "x" in df.columns and "x1" not in df.columns


def in_range(df: DataFrame, r: R.Rect) -> Column:
    return R.has_point(r, "x", "y") if is_point(df) else R.meets(R.rect(), r)


def range_query(df: DataFrame, *boxes: tuple[float, float, float, float]) -> DataFrame:
    """The rows in any of the boxes, each once."""
    test = None
    for b in boxes:
        one = in_range(df, R.Rect(*b))
        test = one if test is None else test | one
    return df if test is None else df.where(test)


def range_queries(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """(qid, row...) for a table (qid, x1, y1, x2, y2) of query boxes: a join on grid cells, whatever the number of boxes."""
    from stratum.operators.joins import spatial_join

    queries = boxes.select(F.col("qid").alias("id"), *R.BOX)
    return spatial_join(queries, df, keep_left=["id"]).withColumnRenamed("l_id", "qid")


def ranked(df: DataFrame, x, y, metric: str = "max") -> Column:
    """Distance of a row to (x, y). Rectangles rank by their farthest corner (``max``) or by their nearest point (``min``)."""
    if is_point(df):
        return R.distance("x", "y", x, y)
    return R.max_distance(R.rect(), x, y) if metric == "max" else R.min_distance(R.rect(), x, y)


def knn(df: DataFrame, x: float, y: float, k: int, metric: str = "max", tie: str = "id", distinct: bool = False) -> DataFrame:
    """The ``k`` nearest rows by distance, then ``tie``: a bounded heap per task and one merge (TakeOrderedAndProject)."""
    base = df.dropDuplicates() if distinct else df
    return base.withColumn("distance", ranked(df, x, y, metric)).orderBy("distance", tie).limit(k)


def knn_join(queries: DataFrame, df: DataFrame, k: int, cell: float, tie: str = "id", queries_id: str = "qid") -> DataFrame:
    """For each query point (qid, x, y) its ``k`` nearest points: qid, rank, distance and the row's columns, prefixed p_.

    Points and queries meet on square cells, at first of side ``cell``: a query looks into its own cell and the eight around it. It is settled when the
    k-th distance found lies within the part of the plane that it has seen, or when that part holds all data; the others go on with cells twice as wide.
    So a query far from all data meets nine cells a round like any other. The loop is on query ids and counts, the data stay in place.
    """
    data = df.select(*[F.col(c).alias(f"p_{c}") for c in df.columns])
    ask = queries.select(F.col(queries_id).alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    low_x, high_x, low_y, high_y = data.agg(F.min("p_x"), F.max("p_x"), F.min("p_y"), F.max("p_y")).first()
    order = Window.partitionBy("qid").orderBy("distance", f"p_{tie}")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    done, turn, side, scratch = None, 0, float(cell), Scratch(df.sparkSession, "knn")
    while True:
        at = lambda c: F.floor(F.col(c) / side).cast("long")  # noqa: E731, B023
        cells = ask.select("*", around.alias("o")).select("qid", "qx", "qy", (at("qx") + F.col("o.i")).alias("cx"), (at("qy") + F.col("o.j")).alias("cy"))
        met = cells.join(data.withColumns({"cx": at("p_x"), "cy": at("p_y")}), ["cx", "cy"]).withColumn("distance", R.distance("qx", "qy", "p_x", "p_y"))
        top = scratch.save(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"top{turn}")
        x1, x2, y1, y2 = (at("qx") - 1) * side, (at("qx") + 2) * side, (at("qy") - 1) * side, (at("qy") + 2) * side
        edge = F.least(F.col("qx") - x1, x2 - F.col("qx"), F.col("qy") - y1, y2 - F.col("qy"))
        seen_all = F.lit(True) if low_x is None else (x1 <= low_x) & (x2 > high_x) & (y1 <= low_y) & (y2 > high_y)
        state = ask.withColumn("edge", edge).join(top.groupBy("qid").agg(F.max("rank").alias("n"), F.max("distance").alias("far")), "qid", "left")
        settled = state.where(seen_all | ((F.col("n") == k) & (F.col("far") <= F.col("edge")))).select("qid")
        settled = scratch.save(settled, f"settled{turn}")
        part = top.join(settled, "qid").drop("qx", "qy", "cx", "cy")
        done = part if done is None else done.unionByName(part)
        ask = scratch.save(ask.join(settled, "qid", "left_anti"), f"ask{turn}")
        if ask.limit(1).count() == 0:
            return done
        side, turn = side * 2, turn + 1


def sample(df: DataFrame, ratio: float, seed: int = 1, centroid: bool = False) -> DataFrame:
    """A Bernoulli sample; with ``centroid`` rectangles become their centres."""
    out = df.sample(fraction=ratio, seed=seed)
    if centroid and not is_point(df):
        x, y = R.centre(R.rect())
        out = out.select(*[c for c in df.columns if c not in R.BOX], x.alias("x"), y.alias("y"))
    return out


def sample_n(df: DataFrame, n: int, seed: int = 1, key: str = "id") -> DataFrame:
    """``n`` rows without replacement, the same ones at each run: those with the least hash of their key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def shuffle(df: DataFrame, seed: int = 1) -> DataFrame:
    return df.orderBy(F.rand(seed))


def head(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def tail(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The last ``n`` rows, the last first."""
    return df.orderBy(F.desc(key)).limit(n)


def dedup_points(df: DataFrame, tolerance: float = 0.0, tie: str = "id") -> DataFrame:
    """Points without duplicates. With a tolerance, a point goes if a later one (by x, y, then ``tie``) is nearer than it in both coordinates."""
    if tolerance <= 0:
        return df.dropDuplicates(["x", "y"])
    cell = lambda v: F.floor(F.col(v) / tolerance)
    later = df.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(tie).alias("_t"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    near = df.withColumn("_dx", F.explode(F.array(*map(F.lit, (0, 1))))).withColumn("_dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.withColumns({"_kx": cell("x") + F.col("_dx"), "_ky": cell("y") + F.col("_dy")})
    after = F.struct("_x", "_y", "_t") > F.struct("x", "y", tie)
    hit = near.join(later, (F.col("_kx") == F.col("_cx")) & (F.col("_ky") == F.col("_cy")) & after & (F.col("_x") < F.col("x") + tolerance) & (F.abs(F.col("_y") - F.col("y")) < tolerance))
    return df.join(hit.select(tie).distinct(), tie, "left_anti")
