"""Gridded values in space and time: selection, aggregates, rollups and the choice of periods.

Raster rows have x, y, value and a day (or a timestamp). Rollups hold min, max, sum and count per tile, Z-order
prefix and day, month or year; a query takes whole nodes from them and the base table for the fringe.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import curves, rects as R

MEASURES = ["min", "max", "sum", "count"]


def raster_select(df: DataFrame, box: tuple, first: date, end: date, day: str = "day", fill: float | None = None) -> DataFrame:
    """Rows in the box (half-open) and in [first, end)."""
    out = df.where(R.has_point(R.Rect(*box), "x", "y") & (F.col(day) >= F.lit(first)) & (F.col(day) < F.lit(end)))
    return out if fill is None else out.where(F.col("value") != fill)


def measures(value: str = "value") -> list[Column]:
    return [F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count")]


def raster_aggregate(df: DataFrame, box: tuple, first: date, end: date, day: str = "day", fill: float | None = None) -> DataFrame:
    """One row: min, max, sum, count, avg."""
    total = raster_select(df, box, first, end, day, fill).agg(*measures())
    return total.withColumn("avg", F.col("sum") / F.col("count"))


def with_node(df: DataFrame, space: tuple, level: int) -> DataFrame:
    """Adds ``node``: the Z-order number of the cell, of 2**level a side, that a row lies in."""
    n = 1 << level
    cell = lambda c, a, b: F.least(F.greatest(F.floor((F.col(c) - a) / (b - a) * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return df.withColumn("node", curves.z_order(cell("x", space[0], space[2]), cell("y", space[1], space[3])))


def build_rollups(df: DataFrame, space: tuple, level: int, day: str = "day") -> dict[str, DataFrame]:
    """day, month and year tables (node, period, min, max, sum, count), each from the one before."""
    daily = with_node(df, space, level).groupBy("node", F.col(day).cast("date").alias("period")).agg(*measures())
    out = {"day": daily}
    for name, below in (("month", "day"), ("year", "month")):
        up = out[below].groupBy("node", F.trunc("period", name).alias("period"))
        out[name] = up.agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return out


def periods(first: date, end: date) -> dict[str, list[date]]:
    """[first, end) as whole years, whole months and days, the fewest: starts by kind."""
    out: dict[str, list[date]] = {"year": [], "month": [], "day": []}
    at = first
    while at < end:
        year, month = date(at.year + 1, 1, 1), date(at.year + at.month // 12, at.month % 12 + 1, 1)
        if at.month == at.day == 1 and year <= end:
            kind, to = "year", year
        elif at.day == 1 and month <= end:
            kind, to = "month", month
        else:
            kind, to = "day", at + timedelta(days=1)
        out[kind].append(at)
        at = to
    return out


def overlapping(table: DataFrame, first: date, end: date, contained: bool = False) -> DataFrame:
    """Rows of a table of half-open periods (start, stop) that overlap [first, end), or lie in it."""
    return table.where((F.col("start") >= F.lit(first)) & (F.col("stop") <= F.lit(end)) if contained else (F.col("start") < F.lit(end)) & (F.col("stop") > F.lit(first)))


def missing_periods(days: list[date], months: list[date], years: list[date]) -> dict[str, list[date]]:
    """Months and years of which all days are there and that have no rollup yet."""
    have, want = set(days), {"month": [], "year": []}
    for m in sorted({d.replace(day=1) for d in days}):
        stop = date(m.year + m.month // 12, m.month % 12 + 1, 1)
        if m not in months and all(m + timedelta(days=k) in have for k in range((stop - m).days)):
            want["month"].append(m)
    whole = set(months) | set(want["month"])
    for y in sorted({m.replace(month=1) for m in whole}):
        if y not in years and all(date(y.year, k, 1) in whole for k in range(1, 13)):
            want["year"].append(y)
    return want


def aggregate_with_rollups(base: DataFrame, rollups: dict[str, DataFrame], box: tuple, first: date, end: date, space: tuple, level: int, day: str = "day") -> DataFrame:
    """The result of :func:`raster_aggregate`, from nodes that lie in the box whole and base rows for the rest of it."""
    n = 1 << level
    w, h = (space[2] - space[0]) / n, (space[3] - space[1]) / n
    cx, cy = curves.z_decode(F.col("node"))
    # The nodes at the edge of the space also hold what lies beyond it, so they are never taken whole.
    whole = (space[0] + cx * w >= box[0]) & (space[0] + (cx + 1) * w <= box[2]) & (space[1] + cy * h >= box[1]) & (space[1] + (cy + 1) * h <= box[3]) & (cx > 0) & (cx < n - 1) & (cy > 0) & (cy < n - 1)
    parts = []
    for kind, starts in periods(first, end).items():
        if starts:
            parts.append(rollups[kind].where(whole & F.col("period").isin(starts)).select(*MEASURES))
    fringe = with_node(raster_select(base, box, first, end, day), space, level).where(~whole).agg(*measures())
    every = fringe.select(*MEASURES)
    for p in parts:
        every = every.unionByName(p)
    total = every.agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return total.withColumn("avg", F.col("sum") / F.col("count"))


def fill_holes(values: np.ndarray, fill: float, water: np.ndarray | None = None) -> np.ndarray:
    """Interpolates runs of ``fill`` along rows and along columns and takes the mean of what both give; runs at an
    edge take the nearest value; water stays as it is."""
    a = values.astype(float)
    a[values == fill] = np.nan

    def along(m: np.ndarray) -> np.ndarray:
        out = m.copy()
        for row in out:
            known = np.flatnonzero(~np.isnan(row))
            if len(known):
                row[:] = np.interp(np.arange(len(row)), known, row[known])
        return out

    done = a
    while np.isnan(done).any():  # a cell without known ones in its row or column comes in a later turn
        both = np.stack([along(done), along(done.T).T])
        n = (~np.isnan(both)).sum(axis=0)
        mean = np.where(n > 0, np.nansum(both, axis=0) / np.maximum(n, 1), np.nan)
        new = np.where(np.isnan(done), mean, done)
        if (np.isnan(new) == np.isnan(done)).all():
            new = np.where(np.isnan(new), fill, new)
        done = new
    if water is not None:
        done = np.where(water, values, done)
    return done.astype(values.dtype) if np.issubdtype(values.dtype, np.floating) else np.rint(done).astype(values.dtype)


def recover(tiles: DataFrame, fill: int, by: tuple = ("tile_h", "tile_v", "day")) -> DataFrame:
    """Fills the holes of each tile (row, col, value) of each day; one tile is bounded by the format."""
    schema = tiles.schema

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((rows["row"].max() + 1, rows["col"].max() + 1), fill, np.int64)
        grid[rows["row"], rows["col"]] = rows["value"]
        filled = fill_holes(grid, fill)
        return rows.assign(value=filled[rows["row"], rows["col"]])

    return tiles.groupBy(*by).applyInPandas(one, schema)
