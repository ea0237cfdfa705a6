"""Further registered queries: exact geometry, joins of indexes, files and text layouts, extracts, functions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import curves, rects as R, tags as T
from stratum.kernel import shapes as S
from stratum.operators import geometry as G, index, joins, polygons, raster, select
from stratum.plans import catalog as C
from stratum.scratch import Scratch, spread
from stratum.sources import files, osm, text

# Diamonds: squares on their corners. Two of them meet if their centres' distances in x and y together are at most their radii.


def _diamonds(df: DataFrame, key: str, radius) -> DataFrame:
    df, radius = spread(df.select(key, radius.alias("radius")), key), F.col("radius")
    x, y = F.col(key) * 7919 % 10007, F.col(key) * 104729 % 10007
    point = lambda a, b: F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
    ring = F.concat_ws(", ", point(x - radius, y), point(x, y - radius), point(x + radius, y), point(x, y + radius), point(x - radius, y))
    return df.select(F.col(key).alias("id"), G.from_wkt(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("geom"))


def diamonds_part(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_boxes(_diamonds(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", F.col("p_size")))


def diamonds_supp(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_boxes(_diamonds(spark.read.parquet(f"{sf}/supplier.parquet"), "s_suppkey", 120 + F.col("s_suppkey") % 100))


_DIAMONDS = """, dp AS (SELECT p_partkey AS id, p_partkey * 7919 % 10007 AS cx, p_partkey * 104729 % 10007 AS cy, p_size AS r FROM part),
ds AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 10007 AS cx, s_suppkey * 104729 % 10007 AS cy, 120 + s_suppkey % 100 AS r FROM supplier)
"""
PLOT = (0.013, 0.027, 10007.5, 10006.9)


def _range_polygons(spark, sf):
    query = S.parse_geometry("POLYGON ((2500 5000, 5000 2500, 7500 5000, 5000 7500, 2500 5000))")
    return G.range_geometries(diamonds_part(spark, sf), query).select("id")


def _join_polygons(filter_only):
    return lambda spark, sf: G.join_geometries(diamonds_part(spark, sf), diamonds_supp(spark, sf), ["id"], ["id"], filter_only, strategy="grid")


def _geometry_functions(spark, sf):
    return diamonds_part(spark, sf).select("id", G.to_wkt(F.col("geom")).alias("wkt"), F.round(G.area(F.col("geom")), 6).alias("area"), "x1", "y2")


def _simplify(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    line = F.concat(F.lit("LINESTRING (0 0, 5 "), (F.col("p_size") / 10).cast("string"), F.lit(", 10 0)"))
    return p.select(F.col("p_partkey").alias("id"), G.to_wkt(G.simplified(2.0)(G.from_wkt(line))).alias("wkt"))


def _exit_points(spark, sf):
    c = C.pts_cust(spark, sf).where("x > 100 AND y > 100")
    at = G.exit_point(R.Rect(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)), (F.lit(50.0), F.lit(50.0)), (F.col("x"), F.col("y")))
    return c.select("id", F.round(at["x"], 6).alias("ex"), F.round(at["y"], 6).alias("ey"))


def _plot_segments(spark, sf):
    return G.plot_segments(C.rects_supp(spark, sf), PLOT, 400, 400)


def _plot_polygons(spark, sf):
    return G.plot_polygons(diamonds_supp(spark, sf), PLOT, 100, 100)


# Indexes and their joins.


def _built(spark, df, label, kind, rows):
    return index.build_index(df, Scratch(spark, label).path("index"), kind, rows)


def _two(kind_a, kind_b):
    return lambda spark, sf: (_built(spark, C.rects_part(spark, sf), "two-a", kind_a, 300), _built(spark, C.rects_supp(spark, sf), "two-b", kind_b, 30))


def _join_index_disjoint(spark, sf):
    return index.join_indexes(*_two("str+", "quadtree")(spark, sf), ["id"], ["id"])


def _join_cells(kind, local):
    return lambda spark, sf: index.partition_join(C.rects_part(spark, sf), C.rects_supp(spark, sf), ["id"], ["id"], kind, 300, local)


def _join_points_cells(spark, sf):
    return index.partition_join(C.pts_cust(spark, sf), C.rects_part(spark, sf), ["id"], ["id"], "kdtree", 300)


def _join_repartition(kind):
    return lambda spark, sf: index.repartition_join(_built(spark, C.rects_part(spark, sf), "repartition", kind, 300), C.rects_supp(spark, sf), ["id"], ["id"])


def _join_auto(spark, sf):
    return index.auto_join(*_two("str", "rtree")(spark, sf), ["id"], ["id"])


def _skyline_index(spark, sf):
    return index.skyline_index(_built(spark, C.pts_cust(spark, sf), "skyline", "kdtree", 100), "max-max")


def _hull_index(spark, sf):
    return index.hull_index(_built(spark, C.pts_cust(spark, sf), "hull", "str", 100)).select("x", "y")


def _index_versions(spark, sf):
    """Metadata after a build and two insertions, the second of which is tried twice."""
    pts = C.pts_orders(spark, sf)
    ix = _built(spark, pts.where("id % 3 = 0"), "versions", "quadtree", 2_000)
    index.insert(ix, pts.where("id % 3 = 1"))
    for _ in range(2):
        index.insert(ix, pts.where("id % 3 = 2"), 2)
    return ix.meta.agg(F.sum("record_count").alias("rows"), F.min("x1").alias("x1"), F.max("y2").alias("y2")).withColumn("version", F.lit(ix.version()))


def _index_splice(spark, sf):
    """All rows of an index of which some cells have been cut anew in place."""
    ix = _built(spark, C.pts_orders(spark, sf), "splice", "str", 4_000)
    index.reorganize(ix, index.costliest(ix, 1000.0, 2), None, "kdtree", 1_000)
    counted = ix.rows.groupBy("cell_id").agg(F.count("*").alias("n"))
    right = ix.meta.join(counted, "cell_id", "full").where(F.col("n").eqNullSafe(F.col("record_count"))).count() == ix.meta.count()
    return ix.rows.select("id", "x", "y", F.lit(right).alias("counted"))


def _index_like(spark, sf):
    """Customers dealt to the cells of an index of other customers."""
    pts, scratch = C.pts_cust(spark, sf), Scratch(spark, "like")
    first = index.build_index(pts.where("id % 2 = 0"), scratch.path("a"), "kdtree", 100)
    second = index.repartition_like(pts.where("id % 2 = 1"), first, scratch.path("b"))
    outside = second.rows.join(first.tiles(), "cell_id").where(~R.has_point(R.Rect("cx1", "cy1", "cx2", "cy2"), "x", "y")).count()
    return second.rows.select("id", "x", "y", F.lit(outside).alias("outside"))


def _index_grid_cells(spark, sf):
    """Cells of a grid index, counted anew from the tiles."""
    ix = _built(spark, C.pts_cust(spark, sf), "grid-cells", "grid", 100)
    return ix.meta.select("cell_id", "x1", "y1", "x2", "y2", "record_count")


def _index_zcurve_cells(spark, sf):
    ix = _built(spark, C.pts_cust(spark, sf), "z-cells", "zcurve", 100)
    return ix.meta.select("cell_id", "x1", "y1", "x2", "y2", "record_count")


# Functions.


def _rect_functions(spark, sf):
    a, q = R.rect(), R.Rect(F.lit(4000.0), F.lit(4000.0), F.lit(6000.0), F.lit(5000.0))
    common, wide, far = R.intersection(a, q), R.expanded(a, q), R.buffered(a, 2.0, 3.0)
    moved = R.translated(a, 5.0, -5.0)
    return C.rects_part(spark, sf).select(
        "id", R.area(a).alias("area"), R.width(a).alias("w"), R.height(a).alias("h"), common["x1"].alias("cx1"), common["y2"].alias("cy2"), R.area(wide).alias("wide"), R.area(far).alias("far"),
        R.area(moved).alias("moved"), R.contains(q, a).alias("inside"), F.round(R.min_distance(a, 5000.0, 5000.0), 6).alias("near"), R.touches(a, q).alias("touches"), R.wkt(R.Rect(a.cols()[0].cast("long"), a.cols()[1].cast("long"), a.cols()[2].cast("long"), a.cols()[3].cast("long"))).alias("wkt"),
    )


def _tag_functions(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    raw = F.concat(F.lit("[name#"), "n_name", F.lit(",region#"), F.col("n_regionkey").cast("string"), F.lit(",name#"), F.lower("n_name"), F.lit("]"))
    t = T.parse_tags(raw)
    return n.select(
        "n_nationkey", t["name"].alias("name"), T.format_tags(t).alias("formatted"), T.has_tag(t, ["region"], ["1", "2"]).alias("has"), T.has_tag(t, ["other"]).alias("other"), T.tags_to_pairs(t).alias("pairs"), T.clean_tag(F.concat(F.lit("a#b,"), "n_name")).alias("clean")
    )


def _z_boxes(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    first = F.col("c_custkey") % 1000
    b = curves.z_range_box(first, first + F.col("c_custkey") % 17)
    return c.select(F.col("c_custkey").alias("id"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))


def _tile_boxes(spark, sf):
    t = curves.tile_encode(F.lit(5), F.col("id") % 32, F.col("id") % 31)
    b = curves.tile_box(t, 0.0, 0.0, 1024.0, 512.0)
    return C.pts_cust(spark, sf).select("id", b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))


def _knn_near(spark, sf):
    return select.knn(C.rects_part(spark, sf), 5000.0, 5000.0, 20, "min").select("id", F.round("distance", 6).alias("distance"))


def _knn_distinct(spark, sf):
    p = C.pts_cust(spark, sf)
    return select.knn(p.unionByName(p), 1000.0, 1000.0, 10, distinct=True).select("id", F.round("distance", 6).alias("distance"))


# Files and layouts.


def _written(spark, label, name, df, layout, compression="none"):
    path = f"{Scratch(spark, label).path(name)}"
    text.to_lines(df, layout).write.option("compression", compression).text(path)
    return path


def _text_points(spark, sf):
    """Points written as compressed lines and read again, the layout inferred."""
    return text.read(spark, _written(spark, "text-points", "p", C.pts_cust(spark, sf), "point", "gzip"))


def _text_rects(spark, sf):
    """Rectangles read through a file that lists paths."""
    scratch = Scratch(spark, "text-rects")
    rects = C.rects_part(spark, sf)
    for k in (0, 1):
        text.to_lines(rects.where(F.col("id") % 2 == k), "rect").write.text(scratch.path(f"r{k}"))
    spark.createDataFrame([(scratch.path("r0"),), (scratch.path("r1"),)], "value string").coalesce(1).write.text(scratch.path("all.list"))
    return text.read(spark, scratch.path("all.list"), "rect")


def _text_wkt(spark, sf):
    path = _written(spark, "text-wkt", "g", diamonds_supp(spark, sf), "wkt")
    return text.read(spark, path).select(F.col("line").alias("wkt"), "x1", "y1", "x2", "y2")


def _files_copied(spark, sf):
    """Lines of files that were written, flattened and copied."""
    scratch = Scratch(spark, "copied")
    lines = C.pts_cust(spark, sf).select(F.col("id").cast("string").alias("value"), (F.col("id") % 3).alias("k"))
    lines.write.partitionBy("k").text(scratch.path("tree"))
    files.flatten(spark, scratch.path("tree"), scratch.path("flat"))
    files.copy(spark, scratch.path("flat"), scratch.path("copy"))
    files.copy(spark, scratch.path("flat"), scratch.path("copy"))
    return spark.read.text(scratch.path("copy")).select(F.col("value").cast("long").alias("id"))


def _files_joined(spark, sf):
    scratch = Scratch(spark, "joined")
    ids = C.pts_cust(spark, sf).select(F.col("id").cast("string").alias("value"))
    for k in (0, 1):
        ids.where(F.col("value").cast("long") % 2 == k).repartitionByRange(3, F.col("value").cast("long")).write.text(scratch.path(f"p{k}"))
    files.concat(spark, [scratch.path("p1"), scratch.path("p0")], scratch.path("one"))
    files.compact(spark.read.text(scratch.path("one")), scratch.path("few"), 1000)
    return spark.read.parquet(scratch.path("few")).select(F.col("value").cast("long").alias("id"))


def _reader_by_name(spark, sf):
    scratch = Scratch(spark, "readers")
    text.to_lines(C.pts_cust(spark, sf), "point").write.text(scratch.path("a.points"))
    files.register_reader("points", lambda s, p: text.read(s, p, "point"))
    return files.read(spark, scratch.path("a.points")).unionByName(files.read(spark, f"{sf}/customer.parquet").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y")))


# Extracts: customers as nodes, orders' customers as ways.


def _extract(spark, sf):
    """The folder of an XML extract."""
    path = Scratch(spark, "extract").path("map.osm")
    c = C.pts_cust(spark, sf)
    node = F.format_string('<node id="%d" version="1" lon="%s" lat="%s"><tag k="name" v="c%d"/><tag k="%s" v="%s"/></node>', "id", F.col("x").cast("string"), F.col("y").cast("string"), "id", F.when(F.col("id") % 2 == 0, "leisure").otherwise("shop"), F.when(F.col("id") % 3 == 0, "park").otherwise("bakery"))
    nd = lambda k: F.format_string('<nd ref="%d"/>', F.col("id") + k)
    closed = F.when(F.col("id") % 10 == 1, nd(0)).otherwise(F.lit(""))
    way = F.concat(F.format_string('<way id="%d" version="1">', "id"), nd(0), nd(1), nd(2), closed, F.format_string('<tag k="%s" v="%s"/></way>', F.when(F.col("id") % 20 == 1, "natural").otherwise("highway"), F.when(F.col("id") % 20 == 1, "riverbank").otherwise("primary")))
    ways = c.where("id % 5 = 1")
    relation = F.format_string('<relation id="%d" version="1"><member type="way" ref="%d" role="outer"/><member type="node" ref="1" role=""/><tag k="name" v="r%d"/></relation>', "id", "id", "id")
    lines = c.select(F.concat(node, F.when(F.col("id") % 5 == 1, F.concat(F.lit("\n"), way)).otherwise(F.lit("")), F.when(F.col("id") % 50 == 1, F.concat(F.lit("\n"), relation)).otherwise(F.lit(""))).alias("value"))
    lines.repartition(3).mapInPandas(_framed, "value string").write.text(path)
    return path


def _framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The root element around the lines of each file."""
    yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?><osm>']})
    yield from batches
    yield pd.DataFrame({"value": ["</osm>"]})


def _osm_nodes(spark, sf):
    return osm.nodes(spark, _extract(spark, sf)).select("id", "version", "lon", "lat", F.col("tags")["name"].alias("name"))


def _osm_ways(spark, sf):
    path = _extract(spark, sf)
    points = osm.way_points(osm.ways(spark, path), osm.nodes(spark, path))
    return osm.way_geometries(points).select("way_id", "first_node", "last_node", F.substring_index(G.to_wkt(F.col("geom")), " ", 1).alias("kind"), F.map_keys("tags")[0].alias("tag"))


def _osm_objects(spark, sf):
    path = _extract(spark, sf)
    ways = osm.way_geometries(osm.way_points(osm.ways(spark, path), osm.nodes(spark, path)))
    return osm.objects(osm.relations(spark, path), ways).select("id", "kind", F.substring_index(G.to_wkt(F.col("geom")), " ", 1).alias("shape"))


def _osm_theme(name, source):
    def run(spark, sf):
        path = _extract(spark, sf)
        return osm.theme(osm.nodes(spark, path) if source == "nodes" else osm.ways(spark, path), name).select("id")

    return run


def _osm_edges(spark, sf):
    c = C.pts_cust(spark, sf)
    edges = c.select(F.col("id").alias("edge_id"), F.col("id").alias("node1"), (F.col("id") + 1).alias("node2"))
    return osm.edges_with_nodes(edges, c.select("id", F.col("x").alias("lon"), F.col("y").alias("lat"))).select("edge_id", "node1", "node2", "lon1", "lat1", "lon2", "lat2")


# Unions and rasters.


def _boxes(df, x, y, w, h):
    df = spread(df, df.columns[0])
    point = lambda a, b: F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
    ring = F.concat_ws(", ", point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))
    return df.select("*", G.from_wkt(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("geom"))


def _union_by(spark, sf):
    """Two overlapping squares for each supplier."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("o"))
    return polygons.union_by(_boxes(s, F.col("k") * 10 + F.col("o"), F.col("o"), 2, 2), "k").select("k", F.round(G.area(F.col("geom")), 6).alias("area"))


def _union_groups(spark, sf):
    """Rows of ten boxes that overlap each other."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    group = F.floor(F.col("id") / 10)
    boxes = _boxes(s, F.col("id") % 10 * 2, group * 10, 3, 3)
    return polygons.union(boxes).select("label", F.round(G.area(F.col("geom")), 6).alias("area"))


def _union_lines(spark, sf):
    """Total length of the outline of all boxes, summed over cells."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    boxes = _boxes(s, F.col("id") % 10 * 2, F.floor(F.col("id") / 10) * 10, 3, 3)
    lines = polygons.union_boundaries(boxes, 7.0)
    return lines.agg(F.round(F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))), 6).alias("length"))


def _period_lookup(spark, sf):
    days = C.raster_events(spark, sf).select("day").distinct().select(F.col("day").alias("start"), F.date_add("day", 3).alias("stop"))
    return raster.overlapping(days, date(2024, 1, 10), date(2024, 1, 20)).withColumn("kind", F.lit("overlaps")).unionByName(raster.overlapping(days, date(2024, 1, 10), date(2024, 1, 20), True).withColumn("kind", F.lit("within")))


def _rollups(level):
    def run(spark, sf):
        r = raster.build_rollups(C.raster_events(spark, sf), C.WORLD, 3)[level]
        return r.select("node", "period", "min", "max", F.round("sum", 4).alias("sum"), "count")

    return run


def _delaunay_size(spark, sf):
    t = C._delaunay(spark, sf)
    double = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    return t.agg(F.count("*").alias("triangles"), F.round(F.sum(double / 2), 0).alias("area"), F.min(double > 0).alias("turned"))


def _voronoi_size(spark, sf):
    return C._voronoi(spark, sf).agg(F.count("*").alias("regions"), F.sum(F.when(F.col("closed"), 0).otherwise(1)).alias("open"), F.sum("corners").alias("corners"))


QUERIES = {
    "delaunay_size": _delaunay_size, "voronoi_size": _voronoi_size,
    "range_polygons": _range_polygons, "join_polygons": _join_polygons(False), "join_polygons_filter": _join_polygons(True), "geometry_functions": _geometry_functions, "simplify": _simplify, "exit_points": _exit_points,
    "plot_segments": _plot_segments, "plot_polygons": _plot_polygons,
    "join_index_disjoint": _join_index_disjoint, "join_str_cells": _join_cells("str+", "sweep"), "join_quad_cells": _join_cells("quadtree", "hash"), "join_grid_cells": _join_cells("grid", "sweep"), "join_points_cells": _join_points_cells,
    "join_repartition": _join_repartition("str"), "join_repartition_disjoint": _join_repartition("kdtree"), "join_auto": _join_auto,
    "skyline_index": _skyline_index, "hull_index": _hull_index, "index_versions": _index_versions, "index_splice": _index_splice, "index_like": _index_like, "index_grid_cells": _index_grid_cells, "index_zcurve_cells": _index_zcurve_cells,
    "rect_functions": _rect_functions, "tag_functions": _tag_functions, "z_boxes": _z_boxes, "tile_boxes": _tile_boxes, "knn_near": _knn_near, "knn_distinct": _knn_distinct,
    "text_points": _text_points, "text_rects": _text_rects, "text_wkt": _text_wkt, "files_copied": _files_copied, "files_joined": _files_joined, "reader_by_name": _reader_by_name,
    "osm_nodes": _osm_nodes, "osm_ways": _osm_ways, "osm_objects": _osm_objects, "osm_parks": _osm_theme("parks", "nodes"), "osm_lakes": _osm_theme("lakes", "ways"), "osm_edges": _osm_edges,
    "union_by": _union_by, "union_groups": _union_groups, "union_lines": _union_lines, "period_lookup": _period_lookup, "rollup_day": _rollups("day"), "rollup_year": _rollups("year"),
}

_JOINED = f"SELECT a.id AS l_id, b.id AS r_id FROM rects_part a JOIN rects_supp b ON {C._MEETS}"
_NODES = ", c AS (SELECT id, x, y FROM pts_cust), top AS (SELECT max(id) AS m FROM c) "
_MASK = "(CASE WHEN d = 0 THEN 0 ELSE (1::BIGINT << length(bin(d))) - 1 END)"
_EVEN = lambda z: " + ".join(f"((({z}) >> {2 * k}) & 1) * {1 << k}" for k in range(8))
_ODD = lambda z: " + ".join(f"((({z}) >> {2 * k + 1}) & 1) * {1 << k}" for k in range(8))


def _hilbert_sql() -> str:
    """One nested query for each bit of the curve."""
    at = "SELECT id, trunc((x + 1000) / 11000 * 32767)::BIGINT AS hx, trunc(y / 10007 * 32767)::BIGINT AS hy, 0::BIGINT AS h FROM pts_cust"
    for k in reversed(range(15)):
        s = 1 << k
        bits = f"SELECT *, (hx >> {k}) & 1 AS rx, (hy >> {k}) & 1 AS ry, hx & {s - 1} AS lx, hy & {s - 1} AS ly FROM ({at})"
        flip = f"SELECT id, h + {s * s} * xor(3 * rx, ry) AS h, ry, CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - lx ELSE lx END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - ly ELSE ly END AS fy FROM ({bits})"
        at = f"SELECT id, h, CASE WHEN ry = 0 THEN fy ELSE fx END AS hx, CASE WHEN ry = 0 THEN fx ELSE fy END AS hy FROM ({flip})"
    return f"SELECT id, h FROM ({at})"


_SCALED = "least(greatest(trunc((x - (SELECT min(x) FROM pts_cust)) / (SELECT max(x) - min(x) FROM pts_cust) * 32767), 0), 32767)::BIGINT", "least(greatest(trunc((y - (SELECT min(y) FROM pts_cust)) / (SELECT max(y) - min(y) FROM pts_cust) * 32767), 0), 32767)::BIGINT"
#: Corners of the hull in order, with the next one.
_RING = C.SQL["convex_hull"].replace("SELECT x, y FROM g", ", h AS (SELECT x, y FROM g") + """), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM h),
ring AS (SELECT x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM h, m WINDOW w AS (ORDER BY atan2(y - my, x - mx))),
k AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT x, y FROM pts_cust)) AS n, count(*) AS h, sum(x * ny - nx * y) / 2 AS a FROM ring)
"""
SQL = {
    # Euler: n points, h of them on the hull, have 2n - 2 - h triangles that fill the hull, and 3 corners each.
    "delaunay_size": _RING + "SELECT (2 * n - 2 - h)::BIGINT AS triangles, round(a, 0) AS area, true AS turned FROM k",
    "voronoi_size": _RING + "SELECT n AS regions, h::BIGINT AS open, (3 * (2 * n - 2 - h))::BIGINT AS corners FROM k",
    "range_polygons": _DIAMONDS + "SELECT id FROM dp WHERE abs(cx - 5000) + abs(cy - 5000) <= r + 2500",
    "join_polygons": _DIAMONDS + "SELECT a.id AS l_id, b.id AS r_id FROM dp a JOIN ds b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) <= a.r + b.r",
    "join_polygons_filter": _DIAMONDS + "SELECT a.id AS l_id, b.id AS r_id FROM dp a JOIN ds b ON abs(a.cx - b.cx) < a.r + b.r AND abs(a.cy - b.cy) < a.r + b.r",
    "geometry_functions": _DIAMONDS + "SELECT id, 'POLYGON ((' || (cx - r) || ' ' || cy || ', ' || cx || ' ' || (cy - r) || ', ' || (cx + r) || ' ' || cy || ', ' || cx || ' ' || (cy + r) || ', ' || (cx - r) || ' ' || cy || '))' AS wkt, 2.0::DOUBLE * r * r AS area, (cx - r)::DOUBLE AS x1, (cy + r)::DOUBLE AS y2 FROM dp",
    "simplify": "SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN 'LINESTRING (0 0, 5 ' || CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE (p_size / 10)::VARCHAR END || ', 10 0)' ELSE 'LINESTRING (0 0, 10 0)' END AS wkt FROM part",
    "exit_points": "SELECT id, round(50 + t * (x - 50), 6) AS ex, round(50 + t * (y - 50), 6) AS ey FROM (SELECT *, least(50 / (x - 50), 50 / (y - 50)) AS t FROM pts_cust WHERE x > 100 AND y > 100)",
    "plot_segments": f""", s AS (SELECT (x1 - {PLOT[0]}) / {PLOT[2] - PLOT[0]!r} * 400 AS a, (y1 - {PLOT[1]}) / {PLOT[3] - PLOT[1]!r} * 400 AS b, (x2 - {PLOT[0]}) / {PLOT[2] - PLOT[0]!r} * 400 AS c, (y2 - {PLOT[1]}) / {PLOT[3] - PLOT[1]!r} * 400 AS d FROM rects_supp),
        n AS (SELECT *, greatest(ceil(greatest(abs(c - a), abs(d - b))), 1)::BIGINT AS n FROM s), k AS (SELECT *, unnest(range(n + 1)) AS k FROM n),
        p AS (SELECT floor(a + (c - a) * k / n)::INT AS px, (399 - floor(b + (d - b) * k / n))::INT AS py FROM k)
        SELECT px, py, count(*) AS value FROM p WHERE px BETWEEN 0 AND 399 AND py BETWEEN 0 AND 399 GROUP BY 1, 2""",
    "plot_polygons": _DIAMONDS.rstrip() + f""", p AS (SELECT i::INT AS px, (99 - j)::INT AS py, {PLOT[0]} + (i + 0.5) * {(PLOT[2] - PLOT[0]) / 100!r} AS x, {PLOT[1]} + (j + 0.5) * {(PLOT[3] - PLOT[1]) / 100!r} AS y FROM range(100) a(i), range(100) b(j))
        SELECT px, py, count(*) AS value FROM p JOIN ds ON abs(x - cx) + abs(y - cy) <= r GROUP BY 1, 2""",
    **{k: _JOINED for k in ("join_index_disjoint", "join_str_cells", "join_quad_cells", "join_grid_cells", "join_repartition", "join_repartition_disjoint", "join_auto")},
    "join_points_cells": "SELECT a.id AS l_id, b.id AS r_id FROM pts_cust a JOIN rects_part b ON a.x >= b.x1 AND a.x < b.x2 AND a.y >= b.y1 AND a.y < b.y2",
    "skyline_index": C._skyline_sql("max", "max"),
    "hull_index": C.SQL["convex_hull"],
    "index_versions": "SELECT count(*) AS rows, min(x) AS x1, max(y) AS y2, 2::INT AS version FROM pts_orders",
    "index_splice": "SELECT id, x, y, true AS counted FROM pts_orders",
    "index_like": "SELECT id, x, y, 0::INT AS outside FROM pts_cust WHERE id % 2 = 1",
    "index_grid_cells": """, b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h, ceil(count(*) / 100) AS n FROM pts_cust),
        g AS (SELECT *, greatest(round_even(w / sqrt(w * h / n), 0), 1) AS cols, greatest(round_even(h / sqrt(w * h / n), 0), 1) AS rows FROM b),
        c AS (SELECT x, y, len(list_filter(range(1, cols::BIGINT), lambda k: x >= x0 + w * k / cols)) AS i, len(list_filter(range(1, rows::BIGINT), lambda k: y >= y0 + h * k / rows)) AS j, cols FROM pts_cust, g)
        SELECT (j * cols + i)::BIGINT AS cell_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS record_count FROM c GROUP BY 1""",
    "index_zcurve_cells": f""", z AS (SELECT x, y, {C._Z(*_SCALED, 15)} AS z FROM pts_cust), o AS (SELECT list(z ORDER BY z) AS l, count(*) AS m, ceil(count(*) / 100)::BIGINT AS n FROM z),
        s AS (SELECT list_distinct(list_transform(range(1, n), lambda k: l[m * k // n + 1])) AS s FROM o)
        SELECT len(list_filter(s, lambda v: v <= z))::BIGINT AS cell_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS record_count FROM z, s GROUP BY 1""",
    "rect_functions": """SELECT id, (x2 - x1) * (y2 - y1) AS area, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN m THEN greatest(x1, 4000) END AS cx1, CASE WHEN m THEN least(y2, 5000) END AS cy2,
        (greatest(x2, 6000) - least(x1, 4000)) * (greatest(y2, 5000) - least(y1, 4000)) AS wide, (x2 - x1 + 4) * (y2 - y1 + 6) AS far, (x2 - x1) * (y2 - y1) AS moved, x1 >= 4000 AND y1 >= 4000 AND x2 <= 6000 AND y2 <= 5000 AS inside,
        round(sqrt(greatest(x1 - 5000, 0, 5000 - x2) ** 2 + greatest(y1 - 5000, 0, 5000 - y2) ** 2), 6) AS near, x2 >= 4000 AND x1 <= 6000 AND y2 >= 4000 AND y1 <= 5000 AS touches,
        'POLYGON((' || a || ' ' || b || ', ' || c || ' ' || b || ', ' || c || ' ' || d || ', ' || a || ' ' || d || ', ' || a || ' ' || b || '))' AS wkt
        FROM (SELECT *, x2 > 4000 AND x1 < 6000 AND y2 > 4000 AND y1 < 5000 AS m, x1::BIGINT AS a, y1::BIGINT AS b, x2::BIGINT AS c, y2::BIGINT AS d FROM rects_part)""",
    "tag_functions": """SELECT n_nationkey, lower(n_name) AS name, '[name#' || lower(n_name) || ',region#' || n_regionkey || ']' AS formatted, n_regionkey IN (1, 2) AS has, false AS other,
        '{"name"="' || lower(n_name) || '"}{"region"="' || n_regionkey || '"}' AS pairs, 'a_b_' || n_name AS clean FROM nation""",
    "z_boxes": f", r AS (SELECT c_custkey AS id, (c_custkey % 1000)::BIGINT AS a, xor((c_custkey % 1000)::BIGINT, (c_custkey % 1000 + c_custkey % 17)::BIGINT) AS d FROM customer), m AS (SELECT id, a & ~{_MASK} AS lo, a | {_MASK} AS hi FROM r) SELECT id, {_ODD('lo')} AS x1, {_EVEN('lo')} AS y1, {_ODD('hi')} AS x2, {_EVEN('hi')} AS y2 FROM m",
    "tile_boxes": "SELECT id, id % 32 * 32.0::DOUBLE AS x1, id % 31 * 16.0::DOUBLE AS y1, (id % 32 + 1) * 32.0::DOUBLE AS x2, (id % 31 + 1) * 16.0::DOUBLE AS y2 FROM pts_cust",
    "hilbert": _hilbert_sql(),
    "knn_near": "SELECT id, round(d, 6) AS distance FROM (SELECT id, sqrt(greatest(x1 - 5000, 0, 5000 - x2) ** 2 + greatest(y1 - 5000, 0, 5000 - y2) ** 2) AS d FROM rects_part) ORDER BY d, id LIMIT 20",
    "knn_distinct": C.SQL["knn_index"],
    "text_points": "SELECT x, y FROM pts_cust",
    "text_rects": "SELECT x1, y1, x2, y2 FROM rects_part",
    "text_wkt": _DIAMONDS + "SELECT 'POLYGON ((' || (cx - r) || ' ' || cy || ', ' || cx || ' ' || (cy - r) || ', ' || (cx + r) || ' ' || cy || ', ' || cx || ' ' || (cy + r) || ', ' || (cx - r) || ' ' || cy || '))' AS wkt, (cx - r)::DOUBLE AS x1, (cy - r)::DOUBLE AS y1, (cx + r)::DOUBLE AS x2, (cy + r)::DOUBLE AS y2 FROM ds",
    "files_copied": "SELECT c_custkey AS id FROM customer",
    "files_joined": "SELECT c_custkey AS id FROM customer",
    "reader_by_name": "SELECT x, y FROM pts_cust UNION ALL SELECT c_acctbal, c_custkey::DOUBLE FROM customer",
    "osm_nodes": "SELECT id, 1::INT AS version, x AS lon, y AS lat, 'c' || id AS name FROM pts_cust",
    "osm_ways": _NODES + """SELECT id AS way_id, id AS first_node, CASE WHEN id % 10 = 1 THEN id ELSE least(id + 2, m) END AS last_node,
        CASE WHEN id = m AND id % 10 <> 1 THEN 'POINT' WHEN id % 10 = 1 AND id + 2 <= m THEN 'POLYGON' ELSE 'LINESTRING' END AS kind, CASE WHEN id % 20 = 1 THEN 'natural' ELSE 'highway' END AS tag FROM c, top WHERE id % 5 = 1""",
    "osm_objects": _NODES + """SELECT id, CASE WHEN id % 50 = 1 THEN 'relation' ELSE 'way' END AS kind, CASE WHEN id % 10 = 1 THEN 'POLYGON' ELSE 'LINESTRING' END AS shape FROM c WHERE id % 5 = 1""",
    "osm_parks": "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0",
    "osm_lakes": "SELECT c_custkey AS id FROM customer WHERE c_custkey % 20 = 1",
    "osm_edges": "SELECT a.id AS edge_id, a.id AS node1, b.id AS node2, a.x AS lon1, a.y AS lat1, b.x AS lon2, b.y AS lat2 FROM pts_cust a JOIN pts_cust b ON b.id = a.id + 1",
    "union_by": "SELECT s_suppkey AS k, 7.0::DOUBLE AS area FROM supplier",
    "union_groups": "SELECT min(s_suppkey) AS label, 6.0::DOUBLE * count(*) + 3 AS area FROM supplier GROUP BY s_suppkey // 10",
    "union_lines": "SELECT sum(2 * (2 * n + 1) + 6)::DOUBLE AS length FROM (SELECT count(*) AS n FROM supplier GROUP BY s_suppkey // 10)",
    "period_lookup": ", d AS (SELECT DISTINCT day AS start, day + 3 AS stop FROM raster) SELECT start, stop, 'overlaps' AS kind FROM d WHERE start < DATE '2024-01-20' AND stop > DATE '2024-01-10' UNION ALL SELECT start, stop, 'within' FROM d WHERE start >= DATE '2024-01-10' AND stop <= DATE '2024-01-20'",
    "rollup_day": f"SELECT {C._NODE} AS node, day AS period, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count FROM raster GROUP BY 1, 2",
    "rollup_year": f"SELECT {C._NODE} AS node, date_trunc('year', ts)::DATE AS period, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count FROM raster GROUP BY 1, 2",
}
