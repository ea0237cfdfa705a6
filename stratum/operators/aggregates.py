"""Aggregates over points and rectangles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import rects as R
from stratum.operators.joins import boxed
from stratum.operators.select import is_point


def mbr(df: DataFrame, by: list[str] | None = None, size: Column | None = None) -> DataFrame:
    """Least rectangle around all rows (of each group), their number, and the sum of ``size`` if given. Rows without geometry count, but don't widen."""
    b = boxed(df)
    more = [] if size is None else [F.sum(size).alias("size")]
    return b.groupBy(*(by or [])).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("record_count"), *more)


def file_mbr(df: DataFrame) -> DataFrame:
    """:func:`mbr` of each input file."""
    return mbr(df.withColumn("filename", F.col("_metadata.file_name")), ["filename"])


def count_lines_approx(spark, path: str, start: int = 1_000, error: float = 0.01, confidence: float = 2.576) -> tuple[float, float]:
    """(estimate, half width) of the number of lines: bytes over the mean length of sampled lines, the sample doubled until the
    confidence interval is within ``error``; exact when the sample has become the whole."""
    lines = spark.read.text(path).select((F.octet_length("value") + 1).alias("n"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    n = start
    while True:
        got = lines.orderBy(F.rand(n)).limit(n).agg(F.count("*"), F.avg("n"), F.stddev_samp("n")).first()
        if got[0] < n:
            return float(got[0]), 0.0
        half = confidence * (got[2] or 0.0) / math.sqrt(n)
        if half <= error * got[1]:
            return files / got[1], files / (got[1] - half) - files / got[1] if got[1] > half else float("inf")
        n *= 2


def min_max(df: DataFrame, value: str = "value", fill: float | None = None, by: list[str] | None = None) -> DataFrame:
    kept = df if fill is None else df.where(F.col(value) != fill)
    return kept.groupBy(*(by or [])).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(df: DataFrame, grid: R.Grid, weight: Column | None = None) -> DataFrame:
    """(cx, cy, value): sum of ``weight`` (default: rows) by the cell of the centre; the top edges belong to the last cells."""
    x, y = (F.col("x"), F.col("y")) if is_point(df) else R.centre(R.rect())
    cx, cy = grid.clamp_column(grid.column_of(x)).cast("int"), grid.clamp_row(grid.row_of(y)).cast("int")
    return df.groupBy(cx.alias("cx"), cy.alias("cy")).agg((F.count("*") if weight is None else F.sum(weight)).alias("value"))


def prefix_sums(cells: DataFrame, columns: int, rows: int) -> DataFrame:
    """(cx, cy, total) for each cell of the grid: sum of all cells at or below it in both directions.

    Two running sums over a grid of columns * rows cells, each split by the other coordinate.
    """
    spark = cells.sparkSession
    full = spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("cx"), F.floor(F.col("id") / columns).cast("int").alias("cy"))
    filled = full.join(cells, ["cx", "cy"], "left").fillna(0, ["value"])
    along = Window.partitionBy("cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("cx").orderBy("cy").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("row_total", F.sum("value").over(along)).select("cx", "cy", F.sum("row_total").over(up).alias("total"))


def box_sum(prefix: DataFrame, c1: int, r1: int, c2: int, r2: int) -> float:
    """Sum over the cells c1..c2, r1..r2 (inclusive) from four prefix sums."""
    corners = {(c2, r2): 1, (c1 - 1, r2): -1, (c2, r1 - 1): -1, (c1 - 1, r1 - 1): 1}
    keys = [f"cx = {c} AND cy = {r}" for c, r in corners]
    return sum(corners[x.cx, x.cy] * x.total for x in prefix.where(" OR ".join(keys)).collect())


def partition_stats(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Count, bytes and rectangle of each partition (cell_id)."""
    return mbr(df, ["cell_id"], F.lit(0) if size is None else size)
