"""Registered queries over the given tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import curves, rects as R
from stratum.kernel import partition as P
from stratum.operators import aggregates, extremes, index, joins, raster, render, select, triangulation
from stratum.scratch import Scratch
from stratum.sources import generate as G, osm
from stratum.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]

# Views of the tables as spatial data.


def pts_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") * 7919 % 100003).cast("double").alias("y"))


def pts_cust(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))


def _rects(df: DataFrame, key: str, side) -> DataFrame:
    a, b = (F.col(key) * 7919 % 10007).cast("double"), (F.col(key) * 104729 % 10007).cast("double")
    return df.select(F.col(key).alias("id"), a.alias("x1"), b.alias("y1"), (a + side).alias("x2"), (b + side).alias("y2"))


def rects_part(spark: SparkSession, sf: str) -> DataFrame:
    return _rects(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", F.col("p_size"))


def rects_supp(spark: SparkSession, sf: str) -> DataFrame:
    return _rects(spark.read.parquet(f"{sf}/supplier.parquet"), "s_suppkey", 20 + F.col("s_suppkey") % 100)


def rects_cust(spark: SparkSession, sf: str) -> DataFrame:
    """Wide enough to overlap each other."""
    return _rects(spark.read.parquet(f"{sf}/customer.parquet"), "c_custkey", 100 + F.col("c_custkey") % 100)


def raster_events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select((F.col("event_id") * 37 % 360 - 180).cast("double").alias("x"), (F.col("event_id") * 91 % 180 - 90).cast("double").alias("y"), "value", "ts", F.to_date("ts").alias("day"), "event_id")


SQL_VIEWS = """
WITH pts_orders AS (SELECT o_orderkey AS id, o_totalprice AS x, (o_orderkey * 7919 % 100003)::DOUBLE AS y FROM orders),
pts_cust AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer),
rects_part AS (SELECT p_partkey AS id, (p_partkey * 7919 % 10007)::DOUBLE AS x1, (p_partkey * 104729 % 10007)::DOUBLE AS y1,
  (p_partkey * 7919 % 10007)::DOUBLE + p_size AS x2, (p_partkey * 104729 % 10007)::DOUBLE + p_size AS y2 FROM part),
rects_supp AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 10007)::DOUBLE AS x1, (s_suppkey * 104729 % 10007)::DOUBLE AS y1,
  (s_suppkey * 7919 % 10007)::DOUBLE + 20 + s_suppkey % 100 AS x2, (s_suppkey * 104729 % 10007)::DOUBLE + 20 + s_suppkey % 100 AS y2 FROM supplier),
rects_cust AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007)::DOUBLE AS x1, (c_custkey * 104729 % 10007)::DOUBLE AS y1,
  (c_custkey * 7919 % 10007)::DOUBLE + 100 + c_custkey % 100 AS x2, (c_custkey * 104729 % 10007)::DOUBLE + 100 + c_custkey % 100 AS y2 FROM customer),
raster AS (SELECT (event_id * 37 % 360 - 180)::DOUBLE AS x, (event_id * 91 % 180 - 90)::DOUBLE AS y, value, ts, ts::DATE AS day, event_id FROM events)
"""

SPACE_CUST = (-1000.0, 0.0, 10000.0, 10007.0)
SPACE_ORDERS = (0.0, 0.0, 500000.0, 100003.0)
WORLD = (-180.0, -90.0, 180.0, 90.0)
#: The place of a line in its order; line numbers repeat.
PLACE = "(CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000000 + l_suppkey"
BOXES = [(1, 0.0, 0.0, 2000.0, 3000.0), (2, 5000.0, 5000.0, 5600.0, 9000.0), (3, 9990.0, 0.0, 12000.0, 200.0)]
PROBES = [(1, 1000.0, 1000.0), (2, 5000.0, 9000.0), (3, -900.0, 5.0)]


def _range_points(spark, sf):
    return select.range_query(pts_orders(spark, sf), (100000.0, 20000.0, 200000.0, 70000.0))


def _range_rects(spark, sf):
    return select.range_query(rects_part(spark, sf), (1000.0, 1000.0, 4000.0, 3000.0), (7000.0, 100.0, 7500.0, 9000.0))


def _range_many(spark, sf):
    boxes = spark.createDataFrame(BOXES, "qid long, x1 double, y1 double, x2 double, y2 double")
    return select.range_queries(pts_cust(spark, sf), boxes).select("qid", "r_id")


def _range_index(spark, sf):
    ix = index.build_index(rects_part(spark, sf), Scratch(spark, "range-index").path("str"), "str+", 500)
    return index.range_index(ix, (1000.0, 1000.0, 4000.0, 3000.0)).select("id", *R.BOX)


def _knn_points(spark, sf):
    return select.knn(pts_orders(spark, sf), 250000.0, 50000.0, 10).withColumn("distance", F.round("distance", 6))


def _knn_rects(spark, sf):
    return select.knn(rects_part(spark, sf), 5000.0, 5000.0, 20).select("id", F.round("distance", 6).alias("distance"))


def _knn_many(spark, sf):
    probes = spark.createDataFrame(PROBES, "qid long, x double, y double")
    return select.knn_join(probes, pts_cust(spark, sf), 5, 400.0).select("qid", "rank", F.col("p_id").alias("id"), F.round("distance", 6).alias("distance"))


def _knn_index(spark, sf):
    ix = index.build_index(pts_cust(spark, sf), Scratch(spark, "knn-index").path("kd"), "kdtree", 200)
    return index.knn_index(ix, 1000.0, 1000.0, 10).select("id", F.round("distance", 6).alias("distance"))


def _join_rects(spark, sf):
    return joins.spatial_join(rects_part(spark, sf), rects_supp(spark, sf), ["id"], ["id"], strategy="grid")


def _join_points(spark, sf):
    return joins.spatial_join(pts_cust(spark, sf), rects_part(spark, sf), ["id"], ["id"], strategy="grid")


def _join_broadcast(spark, sf):
    return joins.spatial_join(rects_part(spark, sf), rects_supp(spark, sf), ["id"], ["id"])


def _join_index(spark, sf):
    s = Scratch(spark, "join-index")
    a = index.build_index(rects_part(spark, sf), s.path("a"), "str", 500)
    b = index.build_index(rects_supp(spark, sf), s.path("b"), "rtree", 50)
    return index.join_indexes(a, b, ["id"], ["id"])


def _join_self(spark, sf):
    return joins.self_join(rects_cust(spark, sf), unordered=True, strategy="grid")


def _join_lookup(spark, sf):
    regions = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup_join(spark.read.parquet(f"{sf}/customer.parquet"), regions, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


def _mbr(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    return aggregates.mbr(pts_cust(spark, sf).join(c, F.col("id") == F.col("c_custkey")), ["c_nationkey"])


def _min_max(spark, sf):
    return aggregates.min_max(raster_events(spark, sf).withColumn("month", F.month("ts")), "value", None, ["month"])


def _histogram(spark, sf):
    return aggregates.histogram(pts_orders(spark, sf), R.Grid(*SPACE_ORDERS, 40, 20))


def _prefix_sums(spark, sf):
    return aggregates.prefix_sums(aggregates.histogram(pts_cust(spark, sf), R.Grid(*SPACE_CUST, 16, 16)), 16, 16)


def _cells(spark, sf):
    grid = R.Grid(0.0, 0.0, 10100.0, 10100.0, 20, 10)
    return rects_part(spark, sf).select("id", F.explode(grid.cells_of_rect(R.rect())).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _skyline(direction):
    return lambda spark, sf: extremes.skyline(pts_cust(spark, sf), direction)


def _hull(spark, sf):
    return extremes.convex_hull(pts_cust(spark, sf)).select("x", "y")


def _hull_all(spark, sf):
    return extremes.convex_hull(pts_orders(spark, sf))


def _closest(spark, sf):
    return extremes.closest_pair(pts_cust(spark, sf)).withColumn("distance", F.round("distance", 6))


def _farthest(spark, sf):
    return extremes.farthest_pair(pts_cust(spark, sf)).withColumn("distance", F.round("distance", 6))


def _delaunay(spark, sf):
    return triangulation.delaunay(pts_cust(spark, sf), cell_points=300)


def _voronoi(spark, sf):
    return triangulation.voronoi(_delaunay(spark, sf)).select("x", "y", "closed", F.size("ring").alias("corners"))


def _plot(spark, sf):
    return render.plot_points(pts_orders(spark, sf), SPACE_ORDERS, 200, 100)


def _heat_map(spark, sf):
    return render.heat_map(pts_cust(spark, sf), SPACE_CUST, 100, 100, 3, False)


def _pyramid(spark, sf):
    return render.pyramid(pts_cust(spark, sf), (0.0, 0.0, 10240.0, 10240.0), 3, 64)


def _tile_counts(spark, sf):
    return render.tile_counts(rects_part(spark, sf), (0.0, 0.0, 10240.0, 10240.0), 5)


def _tile_classes(spark, sf):
    return render.classify_tiles(pts_cust(spark, sf), (0.0, 0.0, 10240.0, 10240.0), 5, 40)


def _raster_select(spark, sf):
    return raster.raster_select(raster_events(spark, sf), (-60.0, -30.0, 60.0, 30.0), date(2024, 1, 5), date(2024, 1, 20)).select("event_id", "x", "y", "value")


def _raster_aggregate(spark, sf):
    base, box, space = raster_events(spark, sf), (-100.0, -50.0, 95.0, 61.0), WORLD
    rollups = raster.build_rollups(base, space, 4)
    return raster.aggregate_with_rollups(base, rollups, box, date(2023, 12, 15), date(2024, 2, 10), space, 4).select("min", "max", F.round("sum", 4).alias("sum"), "count", F.round("avg", 6).alias("avg"))


def _rollup_month(spark, sf):
    r = raster.build_rollups(raster_events(spark, sf), WORLD, 3)["month"]
    return r.select("node", "period", "min", "max", F.round("sum", 4).alias("sum"), "count")


def _plot_raster(spark, sf):
    return render.plot_raster(raster_events(spark, sf), WORLD, 36, 18).withColumn("value", F.round("value", 6))


def _z_order(spark, sf):
    p = pts_cust(spark, sf)
    return p.select("id", curves.z_order(F.col("id") % 32768, F.col("y").cast("long")).alias("z"))


def _tiles(spark, sf):
    t = curves.tile_encode(F.lit(7), F.col("id") % 128, F.col("y").cast("long") % 128)
    return pts_cust(spark, sf).select("id", t.alias("tile"), curves.tile_parent(t).alias("parent"))


def _mercator(spark, sf):
    x, y = curves.mercator_world(F.col("x"), F.col("y"))
    h, v = curves.sinusoidal_tile(F.col("x"), F.col("y"))
    return raster_events(spark, sf).select("event_id", F.round(x, 6).alias("wx"), F.round(y, 6).alias("wy"), h.alias("h"), v.alias("v"))


def _partition_stats(kind):
    """For each row how many cells it stands in, whether the metadata of its cell hold it and count its rows, and whether the cell is a part of the data only."""

    def run(spark, sf):
        ix = index.build_index(pts_orders(spark, sf), Scratch(spark, f"stats-{kind}").path("index"), kind, 2_000)
        meta = ix.meta.withColumnsRenamed({c: f"m_{c}" for c in R.BOX})
        counted = ix.rows.groupBy("cell_id").agg(F.count("*").alias("n"))
        total = meta.agg(F.sum("record_count").alias("total"))
        rows = ix.rows.join(meta, "cell_id").join(counted, "cell_id").join(F.broadcast(total))
        inside = (F.col("x") >= F.col("m_x1")) & (F.col("x") <= F.col("m_x2")) & (F.col("y") >= F.col("m_y1")) & (F.col("y") <= F.col("m_y2")) & (F.col("n") == F.col("record_count")) & (F.col("size") > 0)
        return rows.groupBy("id").agg(F.count("*").alias("copies"), F.min(inside).alias("inside"), F.min(2 * F.col("n") < F.col("total")).alias("part"))

    return run


def _insert(spark, sf):
    ix = index.build_index(pts_orders(spark, sf).where("id % 2 = 0"), Scratch(spark, "insert").path("index"), "str", 2_000)
    index.insert(ix, pts_orders(spark, sf).where("id % 2 <> 0"))
    return index.range_index(ix, (100000.0, 20000.0, 200000.0, 70000.0)).select("id", "x", "y")


def _hilbert(spark, sf):
    h = curves.hilbert(curves.scaled(F.col("x"), SPACE_CUST[0], SPACE_CUST[2], 15), curves.scaled(F.col("y"), SPACE_CUST[1], SPACE_CUST[3], 15))
    return pts_cust(spark, sf).select("id", h.alias("h"))


def _segments(spark, sf):
    """Orders as ways, their lines as the nodes."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    pts = li.select(F.col("l_orderkey").alias("way_id"), F.expr(PLACE).alias("position"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"))
    return osm.segments(pts)


def _first_last(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.expr(PLACE)).alias("first_node"), F.max_by("l_partkey", F.expr(PLACE)).alias("last_node"), F.count("*").alias("n"))


def _dangling(spark, sf):
    """Customers whose number no supplier has."""
    return osm.without_partner(spark.read.parquet(f"{sf}/supplier.parquet"), spark.read.parquet(f"{sf}/customer.parquet"), "s_suppkey", "c_custkey").select("c_custkey")


def _sample(spark, sf):
    return select.sample_n(pts_orders(spark, sf), 100)


def _head(spark, sf):
    return select.head(pts_orders(spark, sf), 25)


def _tail(spark, sf):
    return select.tail(pts_orders(spark, sf), 25)


def _dedup(spark, sf):
    return select.dedup_points(pts_cust(spark, sf).select(F.floor(F.col("x") / 500).alias("x"), F.floor(F.col("y") / 500).alias("y")))


def _union_all(spark, sf):
    return pts_orders(spark, sf).unionByName(pts_cust(spark, sf))


def _generated(spark, sf):
    return G.generate(spark, 10_000, (0.0, 0.0, 1000.0, 1000.0), "gaussian").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"))


def _windows(spark, sf):
    w = windowed_counts(raster_events(spark, sf), "ts", 90.0, "1 day")
    return w.select(F.to_date("window.start").alias("day"), "cx", "cy", "value")


QUERIES: dict[str, Query] = {
    "range_points": _range_points, "range_rects": _range_rects, "range_many": _range_many, "range_index": _range_index,
    "knn_points": _knn_points, "knn_rects": _knn_rects, "knn_many": _knn_many, "knn_index": _knn_index,
    "join_rects": _join_rects, "join_points": _join_points, "join_broadcast": _join_broadcast, "join_index": _join_index, "join_self": _join_self, "join_lookup": _join_lookup,
    "mbr": _mbr, "min_max": _min_max, "histogram": _histogram, "prefix_sums": _prefix_sums, "grid_cells": _cells,
    "skyline_max_max": _skyline("max-max"), "skyline_max_min": _skyline("max-min"), "skyline_min_max": _skyline("min-max"), "skyline_min_min": _skyline("min-min"),
    "convex_hull": _hull, "convex_hull_orders": _hull_all, "closest_pair": _closest, "farthest_pair": _farthest, "delaunay": _delaunay, "voronoi": _voronoi,
    "plot_points": _plot, "heat_map": _heat_map, "pyramid": _pyramid, "tile_counts": _tile_counts, "tile_classes": _tile_classes,
    "raster_select": _raster_select, "raster_aggregate": _raster_aggregate, "rollup_month": _rollup_month, "plot_raster": _plot_raster,
    "z_order": _z_order, "tile_ids": _tiles, "projections": _mercator, "hilbert": _hilbert, "index_insert": _insert,
    **{f"index_{k}": _partition_stats(k) for k in [*P.NAMED, "rrstar", "rtreegb", "rtreebb", "rtreebbq", "rstreebb", "rrstreebb"]},
    "osm_segments": _segments, "osm_first_last": _first_last, "osm_dangling": _dangling,
    "sample_n": _sample, "head": _head, "tail": _tail, "dedup_points": _dedup, "union_all": _union_all, "generated": _generated, "windowed_counts": _windows,
}

_MEETS = "a.x2 > b.x1 AND b.x2 > a.x1 AND a.y2 > b.y1 AND b.y2 > a.y1"
_STATS = "SELECT id, 1::BIGINT AS copies, true AS inside, true AS part FROM pts_orders"


def _skyline_sql(dx: str, dy: str) -> str:
    gx, gy = (">" if d == "max" else "<" for d in (dx, dy))
    return f"SELECT DISTINCT x, y FROM pts_cust a WHERE NOT EXISTS (SELECT 1 FROM pts_cust b WHERE b.x {gx}= a.x AND b.y {gy}= a.y AND (b.x {gx} a.x OR b.y {gy} a.y))"


_Z = lambda x, y, bits: " + ".join(f"((({x}) >> {k}) & 1) * {1 << (2 * k + 1)} + ((({y}) >> {k}) & 1) * {1 << (2 * k)}" for k in range(bits))
_NODE = _Z("least(greatest(floor((x + 180) / 360 * 8), 0), 7)::BIGINT", "least(greatest(floor((y + 90) / 180 * 8), 0), 7)::BIGINT", 3)
_GX, _GY = "least(greatest(floor(x / 10240 * 256), 0), 255)::INT", "(255 - least(greatest(floor(y / 10240 * 256), 0), 255))::INT"

SQL: dict[str, str] = {
    "range_points": "SELECT * FROM pts_orders WHERE x >= 100000 AND x < 200000 AND y >= 20000 AND y < 70000",
    "range_rects": "SELECT * FROM rects_part WHERE (x2 > 1000 AND x1 < 4000 AND y2 > 1000 AND y1 < 3000) OR (x2 > 7000 AND x1 < 7500 AND y2 > 100 AND y1 < 9000)",
    "range_many": "SELECT q.qid::BIGINT AS qid, id AS r_id FROM (VALUES " + ", ".join(map(str, BOXES)) + ") q(qid, x1, y1, x2, y2) JOIN pts_cust ON x >= x1 AND x < x2 AND y >= y1 AND y < y2",
    "range_index": "SELECT * FROM rects_part WHERE x2 > 1000 AND x1 < 4000 AND y2 > 1000 AND y1 < 3000",
    "knn_points": "SELECT *, round(sqrt((x - 250000) * (x - 250000) + (y - 50000) * (y - 50000)), 6) AS distance FROM pts_orders ORDER BY sqrt((x - 250000) * (x - 250000) + (y - 50000) * (y - 50000)), id LIMIT 10",
    "knn_rects": "SELECT id, round(d, 6) AS distance FROM (SELECT id, sqrt(greatest(abs(5000 - x1), abs(x2 - 5000)) ** 2 + greatest(abs(5000 - y1), abs(y2 - 5000)) ** 2) AS d FROM rects_part) ORDER BY d, id LIMIT 20",
    "knn_many": "SELECT qid::BIGINT AS qid, rank::INT AS rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT qid, id, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM pts_cust, (VALUES " + ", ".join(map(str, PROBES)) + ") q(qid, px, py))) WHERE rank <= 5",
    "knn_index": "SELECT id, round(d, 6) AS distance FROM (SELECT id, sqrt((x - 1000) ** 2 + (y - 1000) ** 2) AS d FROM pts_cust) ORDER BY d, id LIMIT 10",
    "join_rects": f"SELECT a.id AS l_id, b.id AS r_id FROM rects_part a JOIN rects_supp b ON {_MEETS}",
    "join_points": "SELECT a.id AS l_id, b.id AS r_id FROM pts_cust a JOIN rects_part b ON a.x >= b.x1 AND a.x < b.x2 AND a.y >= b.y1 AND a.y < b.y2",
    "join_broadcast": f"SELECT a.id AS l_id, b.id AS r_id FROM rects_part a JOIN rects_supp b ON {_MEETS}",
    "join_index": f"SELECT a.id AS l_id, b.id AS r_id FROM rects_part a JOIN rects_supp b ON {_MEETS}",
    "join_self": f"SELECT a.id AS l_id, b.id AS r_id FROM rects_cust a JOIN rects_cust b ON a.id < b.id AND {_MEETS}",
    "join_lookup": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "mbr": "SELECT c_nationkey, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS record_count FROM pts_cust JOIN customer ON id = c_custkey GROUP BY c_nationkey",
    "min_max": "SELECT month(ts)::INT AS month, min(value) AS min, max(value) AS max FROM raster GROUP BY 1",
    "histogram": "SELECT least(greatest(floor(x / 12500), 0), 39)::INT AS cx, least(greatest(floor(y / 5000.15), 0), 19)::INT AS cy, count(*) AS value FROM pts_orders GROUP BY 1, 2",
    "prefix_sums": "SELECT i::INT AS cx, j::INT AS cy, (SELECT count(*) FROM (SELECT least(greatest(floor((x + 1000) / 687.5), 0), 15) AS cx, least(greatest(floor(y / 625.4375), 0), 15) AS cy FROM pts_cust) h WHERE h.cx <= i AND h.cy <= j)::BIGINT AS total FROM range(16) a(i), range(16) b(j)",
    "grid_cells": "SELECT (r * 20 + c + 1)::BIGINT AS cell, count(*) AS n, sum(id)::BIGINT AS ids FROM rects_part, range(20) a(c), range(10) b(r) WHERE c BETWEEN least(floor(x1 / 505), 19) AND least(greatest(floor(x1 / 505), ceil(x2 / 505) - 1), 19) AND r BETWEEN least(floor(y1 / 1010), 9) AND least(greatest(floor(y1 / 1010), ceil(y2 / 1010) - 1), 9) GROUP BY 1",
    **{f"skyline_{a}_{b}": _skyline_sql(a, b) for a in ("max", "min") for b in ("max", "min")},
    # A point is a corner if all others lie within less than half a turn around it: the widest gap between their directions is more than half a turn.
    "convex_hull": """, p AS (SELECT DISTINCT x, y FROM pts_cust), d AS (SELECT p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS a FROM p JOIN p q ON p.x <> q.x OR p.y <> q.y),
        g AS (SELECT x, y, a, lead(a) OVER w - a AS gap, first_value(a) OVER w + 2 * pi() - last_value(a) OVER (PARTITION BY x, y ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS turn FROM d WINDOW w AS (PARTITION BY x, y ORDER BY a))
        SELECT x, y FROM g GROUP BY x, y HAVING greatest(max(coalesce(gap, 0)), max(turn)) > pi() + 1e-9""",
    "closest_pair": "SELECT a.id AS id1, b.id AS id2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pts_cust a JOIN pts_cust b ON a.id < b.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1, 2 LIMIT 1",
    "farthest_pair": "SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pts_cust a JOIN pts_cust b ON a.x < b.x OR a.x = b.x AND a.y < b.y ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 DESC, 1, 2, 3, 4 LIMIT 1",
    "plot_points": "SELECT least(greatest(floor(x / 500000 * 200), 0), 199)::INT AS px, (99 - least(greatest(floor(y / 100003 * 100), 0), 99))::INT AS py, count(*) AS value FROM pts_orders WHERE x <= 500000 GROUP BY 1, 2",
    "heat_map": """SELECT (px + dx)::INT AS px, (py + dy)::INT AS py, sum(n)::DOUBLE AS value FROM
        (SELECT least(greatest(floor((x + 1000) / 11000 * 100), 0), 99) AS px, 99 - least(greatest(floor(y / 10007 * 100), 0), 99) AS py, count(*) AS n FROM pts_cust GROUP BY 1, 2),
        range(-3, 3) a(dx), range(-3, 3) b(dy) WHERE dx * dx + dy * dy <= 9 AND px + dx BETWEEN 0 AND 99 AND py + dy BETWEEN 0 AND 99 GROUP BY 1, 2""",
    "pyramid": " UNION ALL ".join(f"SELECT {z}::INT AS z, ({_GX} >> {2 - z}) // 64 AS tx, ({_GY} >> {2 - z}) // 64 AS ty, ({_GX} >> {2 - z}) % 64 AS px, ({_GY} >> {2 - z}) % 64 AS py, count(*) AS value FROM pts_cust WHERE x >= 0 AND x <= 10240 AND y >= 0 AND y <= 10240 GROUP BY ALL" for z in range(3)),
    "tile_counts": "SELECT z::INT AS z, tx::BIGINT AS tx, (2 ** z - 1 - r)::BIGINT AS ty, count(*) AS value FROM rects_part, range(5) a(z), range(16) b(tx), range(16) c(r) WHERE tx < 2 ** z AND r < 2 ** z AND tx BETWEEN least(floor(x1 / 10240 * 2 ** z), 2 ** z - 1) AND least(floor(x2 / 10240 * 2 ** z), 2 ** z - 1) AND r BETWEEN least(floor(y1 / 10240 * 2 ** z), 2 ** z - 1) AND least(floor(y2 / 10240 * 2 ** z), 2 ** z - 1) GROUP BY ALL",
    "tile_classes": """, t AS (SELECT z::INT AS z, least(greatest(floor(x / 10240 * 16), 0), 15)::INT >> (4 - z)::INT AS tx, (15 - least(greatest(floor(y / 10240 * 16), 0), 15))::INT >> (4 - z)::INT AS ty, count(*)::BIGINT AS size FROM pts_cust, range(5) a(z) GROUP BY ALL)
        SELECT t.z, t.tx, t.ty, t.size, CASE WHEN t.size > 40 THEN 'image' WHEN u.size IS NULL OR u.size > 40 THEN 'data' ELSE 'shallow' END AS kind FROM t LEFT JOIN t u ON u.z = t.z - 1 AND u.tx = t.tx >> 1 AND u.ty = t.ty >> 1""",
    "raster_select": "SELECT event_id, x, y, value FROM raster WHERE x >= -60 AND x < 60 AND y >= -30 AND y < 30 AND day >= DATE '2024-01-05' AND day < DATE '2024-01-20'",
    "raster_aggregate": "SELECT min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count, round(avg(value), 6) AS avg FROM raster WHERE x >= -100 AND x < 95 AND y >= -50 AND y < 61 AND day >= DATE '2023-12-15' AND day < DATE '2024-02-10'",
    "rollup_month": f"SELECT {_NODE} AS node, date_trunc('month', ts)::DATE AS period, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count FROM raster GROUP BY 1, 2",
    "plot_raster": "SELECT floor((x + 180) / 10)::INT AS px, (17 - floor((y + 90) / 10))::INT AS py, round(avg(value), 6) AS value FROM raster GROUP BY 1, 2",
    "z_order": f"SELECT id, {_Z('(id % 32768)', 'y::BIGINT', 15)} AS z FROM pts_cust",
    "tile_ids": "SELECT id, (7 << 40) + ((id % 128) << 20) + (y::BIGINT % 128) AS tile, (6 << 40) + (((id % 128) >> 1) << 20) + ((y::BIGINT % 128) >> 1) AS parent FROM pts_cust".replace("(7 << 40)", "7696581394432").replace("(6 << 40)", "6597069766656"),
    "projections": "SELECT event_id, round((x + 180) / 360 * 256, 6) AS wx, round((0.5 - degrees(ln(tan(radians(least(greatest(y, -85.051129), 85.051129)) / 2 + 0.7853981633974483))) / 360) * 256, 6) AS wy, least(greatest(floor((x * cos(radians(y)) + 180) / 10), 0), 35)::INT AS h, least(greatest(floor((90 - y) / 10), 0), 17)::INT AS v FROM raster",
    "index_insert": "SELECT * FROM pts_orders WHERE x >= 100000 AND x < 200000 AND y >= 20000 AND y < 70000",
    **{f"index_{k}": _STATS for k in [*P.NAMED, "rrstar", "rtreegb", "rtreebb", "rtreebbq", "rstreebb", "rrstreebb"]},
    "osm_segments": f"SELECT * FROM (SELECT l_orderkey AS way_id, {PLACE} AS position, l_partkey::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, lead(l_partkey::DOUBLE) OVER w AS x2, lead(l_suppkey::DOUBLE) OVER w AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {PLACE})) WHERE x2 IS NOT NULL",
    "osm_first_last": f"SELECT l_orderkey, arg_min(l_partkey, {PLACE}) AS first_node, arg_max(l_partkey, {PLACE}) AS last_node, count(*) AS n FROM lineitem GROUP BY 1",
    "osm_dangling": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "head": "SELECT * FROM pts_orders ORDER BY id LIMIT 25",
    "tail": "SELECT * FROM pts_orders ORDER BY id DESC LIMIT 25",
    "dedup_points": "SELECT DISTINCT floor(x / 500)::BIGINT AS x, floor(y / 500)::BIGINT AS y FROM pts_cust",
    "union_all": "SELECT id, x, y FROM pts_orders UNION ALL SELECT id, x, y FROM pts_cust",
    "windowed_counts": "SELECT day, floor(x / 90)::BIGINT AS cx, floor(y / 90)::BIGINT AS cy, count(*) AS value FROM raster GROUP BY 1, 2, 3",
}


def queries() -> dict[str, Query]:
    from stratum.plans import wide

    return QUERIES | wide.QUERIES


def oracle_sql() -> dict[str, str]:
    from stratum.plans import wide

    return {k: (SQL_VIEWS.rstrip() + v if v.startswith(",") else SQL_VIEWS + v) for k, v in (SQL | wide.SQL).items()}
