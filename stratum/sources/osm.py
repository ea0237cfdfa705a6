"""OpenStreetMap extracts: nodes, ways and relations from XML, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.tags import clean_tag, has_tag
from stratum.kernel import shapes as S

_TAG = "array<struct<_k:string,_v:string>>"
#: Attributes that all three elements have.
_COMMON = "_id long, _version int, _changeset long, _uid long, _user string, _visible boolean, _timestamp string"
NODE = f"{_COMMON}, _lon double, _lat double, tag {_TAG}"
WAY = f"{_COMMON}, nd array<struct<_ref:long>>, tag {_TAG}"
RELATION = f"{_COMMON}, member array<struct<_type:string,_ref:long,_role:string>>, tag {_TAG}"
#: Keys and values of the thematic extracts.
THEMES = {
    "buildings": (["amenity", "building"], ["yes"]),
    "lakes": (["natural", "waterway"], ["bay", "wetland", "water", "coastline", "riverbank", "dock", "boatyard"]),
    "parks": (
        ["leisure", "boundary", "landuse", "natural"],
        ["wood", "tree_row", "grassland", "park", "golf_course", "national_park", "garden", "nature_reserve", "forest", "grass", "tree", "orchard", "farmland", "protected_area"],
    ),
    "cemetery": (["landuse"], ["cemetery"]),
    "sports": (["leisure", "landuse"], ["sports_centre", "stadium", "track", "pitch", "golf_course", "water_park", "swimming_pool", "recreation_ground", "piste"]),
    "roads": (["highway"], None),
    "postal": (["admin_level"], ["8"]),
    "pois": (["amenity", "shop", "tourism", "historic"], None),
}


def _tags() -> Column:
    pairs = F.coalesce(F.col("tag"), F.array().cast(_TAG))
    named = F.transform(pairs, lambda t: F.struct(clean_tag(t["_k"]).alias("key"), clean_tag(t["_v"]).alias("value")))
    return F.map_from_entries(F.filter(named, lambda e, i: F.size(F.filter(named, lambda o, j: (o["key"] == e["key"]) & (j > i))) == 0))


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _meta() -> list[Column]:
    return [F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_changeset").alias("changeset"), F.col("_uid").alias("uid"), F.col("_user").alias("user"), F.col("_visible").alias("visible"), F.to_timestamp("_timestamp").alias("timestamp")]


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "node", NODE).select(*_meta(), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    refs = F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref:long>>")), lambda n: n["_ref"])
    return _read(spark, path, "way", WAY).select(*_meta(), refs.alias("nodes"), _tags().alias("tags"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return _read(spark, path, "relation", RELATION).select(*_meta(), members.alias("members"), _tags().alias("tags"))


def way_points(ways_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(way_id, position, node_id, x, y, tags): the nodes of each way in order; missing nodes go."""
    refs = ways_.select(F.col("id").alias("way_id"), "tags", F.posexplode("nodes").alias("position", "node_id"))
    at = nodes_.select(F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return refs.join(at, "node_id").select("way_id", "position", "node_id", "x", "y", "tags")


def segments(points: DataFrame, way: str = "way_id", position: str = "position") -> DataFrame:
    """(way, position, x1, y1, x2, y2) of each node and the next. A window per way, whose length is bounded by the format."""
    after = Window.partitionBy(way).orderBy(position)
    both = points.withColumns({"x2": F.lead("x").over(after), "y2": F.lead("y").over(after)})
    return both.where("x2 IS NOT NULL").select(way, position, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def _line(points):
    pts = [(p["x"], p["y"]) for p in points]
    if len(pts) == 1:
        return S.to_wkb(("POINT", pts[0]))
    if len(pts) > 3 and pts[0] == pts[-1]:
        return S.to_wkb(("POLYGON", [pts]))
    return S.to_wkb(("LINESTRING", pts))


def way_geometries(points: DataFrame) -> DataFrame:
    """(way_id, first_node, last_node, geom, tags): closed ways as polygons, others as lines."""
    one = points.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("position", "x", "y"))).alias("p"), F.min_by("node_id", "position").alias("first_node"), F.max_by("node_id", "position").alias("last_node"), F.first("tags").alias("tags"))
    return one.select("way_id", "first_node", "last_node", F.udf(_line, "binary")("p").alias("geom"), "tags")


def assemble(lines: list[list[tuple]]) -> tuple:
    """Rings and lines from pieces that share ends: closed ones are polygons."""
    pieces, out = [list(x) for x in lines if len(x) > 1], []
    while pieces:
        line = pieces.pop(0)
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for k, p in enumerate(pieces):
                if p[0] == line[-1]:
                    line += p[1:]
                elif p[-1] == line[-1]:
                    line += p[::-1][1:]
                elif p[-1] == line[0]:
                    line = p + line[1:]
                elif p[0] == line[0]:
                    line = p[::-1] + line[1:]
                else:
                    continue
                del pieces[k]
                grown = True
                break
        out.append(("POLYGON", [line]) if len(line) > 3 and line[0] == line[-1] else ("LINESTRING", line))
    return out[0] if len(out) == 1 else ("GEOMETRYCOLLECTION", out)


def _assembled(geometries):
    lines = []
    for g in geometries:
        for part in S.flatten(S.parse_wkb(bytes(g))):
            lines += part[1] if part[0] == "POLYGON" else [part[1]] if part[0] == "LINESTRING" else []
    return S.to_wkb(assemble(lines))


def objects(relations_: DataFrame, way_geoms: DataFrame) -> DataFrame:
    """(id, kind, geom, tags): relations put together from their ways, and the ways that no relation has."""
    members = relations_.select("id", "tags", F.explode("members").alias("m")).where("m.type = 'way'").select("id", "tags", F.col("m.ref").alias("way_id"))
    known = members.join(way_geoms.select("way_id", "geom"), "way_id")
    whole = known.groupBy("id").agg(F.collect_list("geom").alias("g"), F.first("tags").alias("tags")).select("id", F.lit("relation").alias("kind"), F.udf(_assembled, "binary")("g").alias("geom"), "tags")
    single = way_geoms.join(members.select("way_id").distinct(), "way_id", "left_anti").select(F.col("way_id").alias("id"), F.lit("way").alias("kind"), "geom", "tags")
    return whole.unionByName(single)


def theme(df: DataFrame, name: str, substring: bool = False) -> DataFrame:
    """Rows whose tags belong to a theme."""
    keys, values = THEMES[name]
    return df.where(has_tag(F.col("tags"), keys, values, substring))


def without_partner(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of the right side that no row of the left one refers to: a right outer join, of which the unmatched half stays."""
    keys = left.select(F.col(left_key).alias("_key")).where("_key IS NOT NULL").distinct()
    return keys.join(right, F.col("_key") == F.col(right_key), "right").where("_key IS NULL").drop("_key")


def edges_with_nodes(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges (edge_id, node1, node2, ...) with the places of both ends."""
    at = lambda k: nodes_.select(F.col("id").alias(f"node{k}"), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"))
    return edges.join(at(1), "node1").join(at(2), "node2")


def _kml(g: tuple) -> str:
    pts = lambda r: " ".join(f"{x!r},{y!r}" for x, y in r)
    out = []
    for kind, c in S.flatten(g):
        if kind == "POINT":
            out.append(f"<Point><coordinates>{c[0]!r},{c[1]!r}</coordinates></Point>")
        elif kind == "LINESTRING":
            out.append(f"<LineString><coordinates>{pts(c)}</coordinates></LineString>")
        else:
            rings = "".join(f"<{w}BoundaryIs><LinearRing><coordinates>{pts(r)}</coordinates></LinearRing></{w}BoundaryIs>" for r, w in zip(c, ["outer", *["inner"] * len(c)]))
            out.append(f"<Polygon>{rings}</Polygon>")
    return out[0] if len(out) == 1 else f"<MultiGeometry>{''.join(out)}</MultiGeometry>"


def kml_placemark(id_, geom, tags):
    from xml.sax.saxutils import escape

    tags = tags or {}
    style = next((t for t, (keys, values) in THEMES.items() if any(k in keys and (values is None or v in values) for k, v in tags.items())), "default")
    data = "".join(f'<Data name="{escape(k, {chr(34): "&quot;"})}"><value>{escape(v)}</value></Data>' for k, v in sorted(tags.items()))
    return f'<Placemark id="{id_}"><name>{escape(tags.get("name", str(id_)))}</name><styleUrl>#{style}</styleUrl><ExtendedData>{data}</ExtendedData>{_kml(S.parse_wkb(bytes(geom)))}</Placemark>'


def to_kml(df: DataFrame) -> DataFrame:
    """A column ``value`` of placemarks, to be put between the lines of :data:`KML_HEAD` and :data:`KML_TAIL`."""
    return df.select(F.udf(kml_placemark, "string")("id", "geom", "tags").alias("value"))


KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_TAIL = "</Document></kml>"
