"""Text forms of shapes: readers by layout, inference of the layout from a few lines, and writers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.tags import format_tags, parse_tags
from stratum.kernel import shapes as S
from stratum.operators import geometry

#: Columns of each layout, in order; d double, l long, s string, t tags, g geometry.
LAYOUTS = {
    "point": (",", [("x", "d"), ("y", "d")]),
    "rect": (",", [("x1", "d"), ("y1", "d"), ("x2", "d"), ("y2", "d")]),
    "circle": (",", [("x", "d"), ("y", "d"), ("r", "d")]),
    "osmpoint": ("\t", [("id", "l"), ("x", "d"), ("y", "d"), ("tags", "t")]),
    "osm": ("\t", [("id", "l"), ("geom", "g"), ("tags", "t")]),
    "osmedge": (",", [("edge_id", "l"), ("node1", "l"), ("lon1", "d"), ("lat1", "d"), ("node2", "l"), ("lon2", "d"), ("lat2", "d"), ("way_id", "l"), ("tags", "s")]),
    "nasapoint": (",", [("x", "d"), ("y", "d"), ("value", "i"), ("t", "l")]),
    "nasarect": (",", [("x1", "d"), ("y1", "d"), ("x2", "d"), ("y2", "d"), ("value", "i"), ("t", "l")]),
    "tweet": (",", [("id", "l"), ("y", "d"), ("x", "d")]),
}
_TYPES = {"d": "double", "l": "long", "i": "int", "s": "string"}
_FLOAT = re.compile(r"\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*")


@dataclass(frozen=True)
class Layout:
    """``name`` of a layout, or "wkt", or "csv" with the geometry in ``column`` (from 0) of fields parted by ``separator``."""

    name: str
    separator: str = "\t"
    column: int = 0


def _is_geometry(text: str) -> bool:
    try:
        return S.parse_geometry(text) is not None
    except (ValueError, KeyError, IndexError):
        return False


def infer_layout(lines: list[str]) -> Layout | None:
    """The layout that all lines have; None if there is none."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return None
    numeric = lambda parts: all(_FLOAT.fullmatch(p) for p in parts)
    rows = [x.split(",") for x in lines]
    if all(numeric(r) for r in rows):
        for n, name in ((2, "point"), (4, "rect")):
            if all(len(r) == n for r in rows):
                return Layout(name, ",")
    tabs = [x.split("\t") for x in lines]
    tags = lambda t: re.fullmatch(r"\s*\[.*\]\s*", t) is not None
    if all(len(r) == 4 and numeric(r[:3]) and tags(r[3]) for r in tabs):
        return Layout("osmpoint")
    if all(len(r) == 3 and numeric(r[:1]) and _is_geometry(r[1]) and tags(r[2]) for r in tabs):
        return Layout("osm")
    if all(len(x.split(",", 8)) == 9 and numeric(x.split(",", 8)[:8]) for x in lines):
        return Layout("osmedge", ",")
    if all(_is_geometry(x) for x in lines):
        return Layout("wkt")
    for separator in ("\t", ";", "|", ","):
        parts = [x.split(separator) for x in lines]
        for k in range(min(map(len, parts))):
            if all(_is_geometry(r[k]) for r in parts):
                return Layout("csv", separator, k)
    return None


def _geometry(text: Column) -> Column:
    return F.udf(_parsed, "struct<geom:binary,x1:double,y1:double,x2:double,y2:double>")(text)


def _parsed(text):
    try:
        g = S.parse_geometry(text)
    except (ValueError, KeyError, IndexError):
        g = None
    e = S.envelope(g)
    return (None if g is None else S.to_wkb(g), *(e or (None,) * 4))


def _field(text: Column, kind: str) -> Column:
    if kind == "t":
        return parse_tags(text)
    return text if kind == "s" else text.try_cast(_TYPES[kind])


def parse(lines: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Columns of the layout from a column of lines; geometries as binary form with their rectangle. Numbers that can't be read are null."""
    if layout.name in ("wkt", "csv"):
        cell = F.col(value) if layout.name == "wkt" else F.get(F.split(F.col(value), re.escape(layout.separator)), F.lit(layout.column))
        return lines.withColumn("_g", _geometry(cell)).select(F.col(value).alias("line"), "_g.*")
    separator, columns = LAYOUTS[layout.name]
    parts = F.split(F.col(value), re.escape(separator), len(columns))
    out, geometry = [], False
    for k, (name, kind) in enumerate(columns):
        cell = F.get(parts, F.lit(k))
        if kind == "g":
            out.append(_geometry(cell).alias("_g"))
            geometry = True
        else:
            out.append(_field(cell, kind).alias(name))
    df = lines.select(*out)
    return df.select(*[c for c, k in columns if k != "g"], "_g.*") if geometry else df


def read(spark: SparkSession, path: str | list[str], layout: str | Layout | None = None) -> DataFrame:
    """Shapes from text files (compressed ones too, wildcards as Spark knows them). Without a layout it is inferred from ten lines.
    A path that ends in .list names a file of paths."""
    paths = [path] if isinstance(path, str) else list(path)
    listed = [p for p in paths if p.endswith(".list")]
    paths = [p for p in paths if p not in listed] + ([r.value for r in spark.read.text(listed).collect() if r.value.strip()] if listed else [])
    lines = spark.read.text(paths)
    if isinstance(layout, str):
        layout = Layout(layout)
    layout = layout or infer_layout([r.value for r in lines.limit(10).collect()])
    if layout is None:
        raise ValueError(f"no layout fits {path}")
    return parse(lines, layout)


def wkb_to_wkt(data) -> Column:
    return geometry.to_wkt(data)


def to_lines(df: DataFrame, layout: str) -> DataFrame:
    """A column ``value`` of lines in a layout."""
    if layout == "wkt":
        return df.select(wkb_to_wkt("geom").alias("value"))
    separator, columns = LAYOUTS[layout]
    cells = [wkb_to_wkt("geom") if k == "g" else format_tags(F.col(c)) if k == "t" else F.col(c).cast("string") for c, k in columns]
    return df.select(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))


def write(df: DataFrame, path: str, layout: str) -> None:
    to_lines(df, layout).write.text(path)
