"""Indexes: data partitioned in space, with metadata that queries prune by.

A built index is a folder. ``data/b=<n>/cell_id=<c>`` holds the Parquet of batch n, each file sorted along the Z-curve so that row
groups have narrow bounds; ``meta/v=<n>`` has a row (cell_id, x1, y1, x2, y2, record_count, size, disjoint) per cell as of batch n, the rectangle being that of the
rows and the size that of the files. A change writes its batch first and the metadata of its version last; readers see the newest complete
version and no batch beyond it, so a failed change leaves nothing behind and is repeated under the same number. The partitioner itself is kept for later batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stratum.functions import curves, rects as R
from stratum.kernel import hull as H, partition as P, sweep
from stratum.operators.joins import _test, boxed, partition_pairs, spatial_join
from stratum.operators.select import in_range, is_point
from stratum.scratch import Scratch, spread

SAMPLE_ROWS = 100_000
#: Trees built point by point take a smaller sample.
INSERTION_ROWS = 3_000
#: The bounded result of a driver-side build; its cells are a few thousand at most.
CELL_ROWS = 250_000


@dataclass
class Index:
    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest complete version; -1 if there is none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return -1
        names = [x.getPath() for x in fs.listStatus(hadoop)]
        return max((int(x.getName()[2:]) for x in names if x.getName().startswith("v=") and fs.exists(self._child(x, "_SUCCESS"))), default=-1)

    def _child(self, parent, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent, name)

    @property
    def meta(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/meta/v={self.version():06d}").drop("replaced")

    @property
    def rows(self) -> DataFrame:
        """All rows with their cell_id, of the cells that the newest version lists."""
        v = self.version()
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data").where(F.col("b") <= v).drop("b").withColumn("cell_id", F.col("cell_id").cast("long"))
        meta = self.spark.read.parquet(f"{self.path}/meta/v={v:06d}")
        if not meta.agg(F.max("replaced")).first()[0]:
            return rows
        return rows.join(F.broadcast(meta.select("cell_id")), "cell_id", "left_semi")  # a row per cell

    def partitioner(self):
        files = self.spark.read.format("binaryFile").load(f"{self.path}/partitioner-*").where(F.substring_index("path", "-", -1).cast("int") <= self.version())
        return pickle.loads(files.orderBy(F.substring_index("path", "-", -1).cast("int").desc()).first().content)  # noqa: S301  written by this module

    @property
    def disjoint(self) -> bool:
        return bool(self.meta.agg(F.max("disjoint")).first()[0])

    def tiles(self) -> DataFrame:
        """(cell_id, cx1, cy1, cx2, cy2): the partitioner's own rectangles, which tile the plane if the index is disjoint."""
        p = self.partitioner()
        return self.spark.createDataFrame([(int(i), *map(float, b)) for i, b in zip(p.ids, p.boxes)], "cell_id long, cx1 double, cy1 double, cx2 double, cy2 double")


def sample_points(df: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[tuple, int, np.ndarray]:
    """(rectangle around all, number of rows, centres of a bounded sample)."""
    b = boxed(df).where("x1 IS NOT NULL AND y1 IS NOT NULL")
    n, *box = b.agg(F.count("*"), F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    if not n:
        return (0.0, 0.0, 1.0, 1.0), 0, np.zeros((0, 2))
    x, y = R.centre(R.rect())
    pts = b.select(x.alias("x"), y.alias("y")).sample(fraction=min(1.0, 1.1 * rows / n), seed=1).limit(rows).toPandas()
    return tuple(map(float, box)), n, pts.to_numpy(float)


def assign(df: DataFrame, partitioner, disjoint: bool) -> DataFrame:
    """``df`` with a cell_id: one per row, or a row for each cell that it touches. Rows without geometry go."""
    if isinstance(partitioner, P.Cells):
        partitioner.prepare()
    keep = spread(boxed(df).where("x1 IS NOT NULL AND y1 IS NOT NULL"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x1, y1, x2, y2 = (b[c].to_numpy(float) for c in R.BOX)
            if disjoint:
                yield b.assign(cells=[c.tolist() for c in partitioner.overlaps(x1, y1, x2, y2)])
            else:
                yield b.assign(cells=[[int(c)] for c in partitioner.assign((x1 + x2) / 2, (y1 + y2) / 2)])

    out = keep.mapInPandas(run, StructType([*keep.schema.fields, StructField("cells", ArrayType(LongType()))]))
    return out.select(*df.columns, F.explode("cells").alias("cell_id"))


def _write(df: DataFrame, path: str, box: tuple, batch: int) -> None:
    """Writes a batch; an earlier attempt at it goes."""
    x, y = (F.col("x"), F.col("y")) if is_point(df) else R.centre(R.rect())
    z = curves.z_order(curves.scaled(x, box[0], box[2], 16), curves.scaled(y, box[1], box[3], 16))
    df.withColumn("_z", z).repartition("cell_id").sortWithinPartitions("cell_id", "_z").drop("_z").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/data/b={batch}")


def _merged() -> list:
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("record_count").alias("record_count"), F.sum("size").alias("size")]


def _stats(spark: SparkSession, path: str, disjoint: bool, batch: int) -> DataFrame:
    """A row per cell of one batch: reads that batch's files alone. Each file is counted with its size once."""
    rows = boxed(spark.read.option("basePath", f"{path}/data/b={batch}").parquet(f"{path}/data/b={batch}").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_bytes")))
    files = rows.groupBy(F.col("cell_id").cast("long").alias("cell_id"), "_file").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("record_count"), F.max("_bytes").alias("size"))
    return files.groupBy("cell_id").agg(*_merged()).withColumn("disjoint", F.lit(disjoint))


def _publish(meta: DataFrame, path: str, version: int, replaced: bool = False) -> None:
    meta.withColumn("replaced", F.lit(replaced)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/v={version:06d}")


def _create(df: DataFrame, path: str, partitioner, replicate: bool, box: tuple) -> Index:
    spark = df.sparkSession
    for old in ("meta", "data"):
        _remove(spark, f"{path}/{old}")
    _write(assign(df, partitioner, replicate), path, box, 0)
    _save_bytes(spark, f"{path}/partitioner-0", pickle.dumps(partitioner))
    _publish(_stats(spark, path, replicate, 0), path, 0)
    return Index(spark, path)


def curve_ranges(df: DataFrame, kind: str, box: tuple, n: int, cells: int) -> P.Curve:
    """Ranges of a curve with equal shares of all rows, not of a sample: rows are counted by the upper half of their place on the curve, of which there are
    32,768, and within the blocks that hold an end of a range by its lower half."""
    curve = P.Curve(box, np.zeros(0, np.int64), kind, kind)
    ranks = np.unique([n * k // cells for k in range(1, cells)]).astype(np.int64)
    if not n or not len(ranks):
        return curve

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, m = np.unique(curve.values(b.x.to_numpy(float), b.y.to_numpy(float)), return_counts=True)
            yield pd.DataFrame({"high": v >> 15, "low": v & 32767, "m": m})

    x, y = R.centre(R.rect())
    scratch = Scratch(df.sparkSession, "curve")
    counted = scratch.save(boxed(df).where("x1 IS NOT NULL AND y1 IS NOT NULL").select(x.alias("x"), y.alias("y")).mapInPandas(places, "high long, low long, m long").groupBy("high", "low").agg(F.sum("m").alias("m")), "places")
    blocks = counted.groupBy("high").agg(F.sum("m").alias("m")).orderBy("high").toPandas()  # at most 32,768 rows
    ends = blocks.m.cumsum().to_numpy()
    block = np.searchsorted(ends, ranks, side="right")
    wanted = {int(blocks.high[i]): ranks[block == i] - (ends[i] - blocks.m[i]) for i in np.unique(block).tolist()}

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low")
        at = np.searchsorted(rows.m.cumsum().to_numpy(), wanted[int(key[0])], side="right")
        return pd.DataFrame({"v": (int(key[0]) << 15) + rows.low.to_numpy()[np.unique(at)]})

    held = df.sparkSession.createDataFrame([(h,) for h in wanted], "high long")
    splits = counted.join(F.broadcast(held), "high").groupBy("high").applyInPandas(pick, "v long").toPandas().v  # fewer than cells
    scratch.drop("places")
    return P.Curve(box, np.unique(splits.to_numpy(np.int64)), kind, kind)


def build_index(df: DataFrame, path: str, kind: str = "str", rows_per_cell: int = CELL_ROWS, disjoint: bool | None = None) -> Index:
    """Partitions and writes ``df``. ``kind``: a named combination (which says whether rows are replicated) or a builder's name."""
    name, named = P.NAMED.get(kind, (kind, False))
    box, n, sample = sample_points(df, INSERTION_ROWS if "bb" in name else SAMPLE_ROWS)
    cells = -(-n // rows_per_cell) or 1
    partitioner = curve_ranges(df, name, box, n, cells) if name in ("zcurve", "hilbert") else P.build(name, box, cells, sample)
    return _create(df, path, partitioner, (named if disjoint is None else disjoint) and partitioner.disjoint, box)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _save_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    stream.write(bytearray(data))
    stream.close()


def like(index: Index) -> P.Cells:
    """The cells of an index as a partitioner: its tiles if they are disjoint, else the rectangles around its rows."""
    if index.disjoint:
        return index.partitioner()
    meta = index.meta.orderBy("cell_id").toPandas()  # a row per cell
    return P.Cells(meta[["x1", "y1", "x2", "y2"]].to_numpy(float), meta["cell_id"].to_numpy(np.int64), False)


def repartition_like(df: DataFrame, index: Index, path: str) -> Index:
    """Partitions ``df`` by the cells of another index; replicated if those are disjoint."""
    box = tuple(map(float, index.meta.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()))
    return _create(df, path, like(index), index.disjoint, box)


def prune(index: Index, box: tuple, keep: Callable[[DataFrame], DataFrame] | None = None) -> list[int]:
    """Ids of the cells whose rectangle the box touches; ``keep``: a further filter on the metadata."""
    meta = index.meta.where(R.touches(R.rect(), R.Rect(*box)))
    return [r[0] for r in (keep(meta) if keep else meta).select("cell_id").collect()]


def range_index(index: Index, box: tuple) -> DataFrame:
    """Range query that reads the cells it needs only. Replicated rows are reported from the cell of their reference point."""
    cells = prune(index, box)
    rows = index.rows.where(F.col("cell_id").isin(cells))
    rows = rows.where(in_range(rows, R.Rect(*box)))
    if not index.disjoint or is_point(rows):
        return rows.drop("cell_id")
    px, py = R.reference_point(R.rect(), R.Rect(*box))
    return rows.join(F.broadcast(index.tiles()), "cell_id").where(R.has_point(R.Rect("cx1", "cy1", "cx2", "cy2"), px, py)).drop("cell_id", "cx1", "cy1", "cx2", "cy2")


def skyline_cells(index: Index, direction: str = "max-max") -> DataFrame:
    """The metadata of the cells that can hold a point of the skyline: no other cell's rectangle lies beyond theirs wholly. Each rectangle around
    rows has a row on each of its sides, so it dominates all that its worse corners do."""
    sx, sy = (1 if d == "max" else -1 for d in direction.split("-"))
    cells = index.meta.toPandas()  # a row per cell
    far = np.stack([np.where(sx > 0, cells.x2, -cells.x1), np.where(sy > 0, cells.y2, -cells.y1)], axis=1)
    near = np.stack([np.where(sx > 0, cells.x1, -cells.x2), np.where(sy > 0, cells.y1, -cells.y2)], axis=1)
    # A row on the far side in x is at least as high as the near side in y, and the other way round.
    sure = np.vstack([np.stack([far[:, 0], near[:, 1]], axis=1), np.stack([near[:, 0], far[:, 1]], axis=1)])
    best = H.skyline(sure)[::-1]  # by x upwards, y downwards: of those no less in x than a cell the first is the highest
    at = np.searchsorted(best[:, 0], far[:, 0], side="left")
    there = best[np.minimum(at, len(best) - 1)]
    keep = ~((at < len(best)) & (there[:, 1] >= far[:, 1]) & (there > far).any(axis=1))
    return index.meta.where(F.col("cell_id").isin([int(c) for c, k in zip(cells.cell_id, keep) if k]))


def skyline_index(index: Index, direction: str = "max-max") -> DataFrame:
    """Skyline of an indexed set of points that reads only the cells which can hold some of it."""
    from stratum.operators.extremes import skyline

    cells = [r[0] for r in skyline_cells(index, direction).select("cell_id").collect()]
    return skyline(index.rows.where(F.col("cell_id").isin(cells)), direction)


def hull_index(index: Index) -> DataFrame:
    """Convex hull of an indexed set of points: a corner of the hull is on the skyline of one of the four directions, so the cells of those are enough."""
    from stratum.operators.extremes import convex_hull

    cells = {r[0] for a in ("max", "min") for b in ("max", "min") for r in skyline_cells(index, f"{a}-{b}").select("cell_id").collect()}
    return convex_hull(index.rows.where(F.col("cell_id").isin(sorted(cells))))


def knn_index(index: Index, x: float, y: float, k: int, metric: str = "max", tie: str = "id") -> DataFrame:
    """Nearest rows from the cells that can hold them: the k-th distance within the nearest cells with k rows bounds the search."""
    from stratum.operators.select import knn

    low, high = R.min_distance(R.rect(), x, y), R.max_distance(R.rect(), x, y)
    near = index.meta.select("cell_id", "record_count", low.alias("low"), high.alias("high")).orderBy("high").collect()  # a row per cell
    seen, bound = 0, None
    for r in near:
        seen += r.record_count
        if seen >= k:
            bound = r.high
            break
    cells = [r.cell_id for r in near if bound is None or r.low <= bound]
    rows = index.rows.where(F.col("cell_id").isin(cells)).drop("cell_id")
    rows = rows.dropDuplicates([tie]) if index.disjoint and not is_point(rows) else rows
    return knn(rows, x, y, k, metric, tie)


def insert(index: Index, batch: DataFrame, version: int | None = None) -> int:
    """Adds a batch by the index's own cells and publishes the next version, which it returns. Only the batch is read; its statistics are merged
    with those of the cells. ``version``: a number above all earlier ones; if it has been published already, nothing happens."""
    current = index.version()
    version = current + 1 if version is None else version
    if version <= current:
        return current
    meta, disjoint = index.meta, index.disjoint
    box = meta.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    replaced = bool(index.spark.read.parquet(f"{index.path}/meta/v={current:06d}").agg(F.max("replaced")).first()[0])
    placed = assign(batch, index.partitioner(), disjoint)
    _write(placed, index.path, tuple(box), version)
    both = meta.unionByName(_stats(index.spark, index.path, disjoint, version)).groupBy("cell_id").agg(*_merged(), F.max("disjoint").alias("disjoint"))
    _publish(both, index.path, version, replaced)
    return version


def overfull(index: Index, rows_per_cell: int = CELL_ROWS) -> list[int]:
    """Cells with more than their share: what to reorganise."""
    return [r[0] for r in index.meta.where(F.col("record_count") > rows_per_cell).select("cell_id").collect()]


def costliest(index: Index, query: float, n: int) -> list[int]:
    """The ``n`` cells that a square query of side ``query`` reads most from: (w + q)(h + q) * size."""
    cost = (R.width(R.rect()) + query) * (R.height(R.rect()) + query) * F.col("size")
    return [r[0] for r in index.meta.orderBy(cost.desc(), "cell_id").limit(n).select("cell_id").collect()]


def smallest_groups(index: Index, rows_per_cell: int = CELL_ROWS) -> list[list[int]]:
    """Groups of overlapping cells whose common rewriting pays: cells whose rectangles overlap, joined where the group's rows fit fewer cells than it has."""
    meta = index.meta.orderBy("cell_id").toPandas()  # a row per cell
    b, n, root = meta[["x1", "y1", "x2", "y2"]].to_numpy(float), meta.record_count.to_numpy(), list(range(len(meta)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(meta)):
        for j in np.flatnonzero((b[:, 0] < b[i, 2]) & (b[i, 0] < b[:, 2]) & (b[:, 1] < b[i, 3]) & (b[i, 1] < b[:, 3])).tolist():
            root[find(j)] = find(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(meta)):
        groups.setdefault(find(i), []).append(i)
    return [[int(meta.cell_id[i]) for i in g] for g in groups.values() if len(g) > -(-int(n[g].sum()) // rows_per_cell)]


def reorganize(index: Index, cells: list[int], path: str | None = None, kind: str = "str", rows_per_cell: int = CELL_ROWS) -> Index:
    """Cuts the given cells anew; their parts take ids after the greatest one. Without ``path`` only the rows of those cells are read and
    written: the next version lists the new cells in place of the old ones, whose files readers pass over. With ``path`` the result is a new index there."""
    spark = index.spark
    if path is not None:
        rows = index.rows
        meta = index.meta.toPandas()
        copy = P.Cells(meta[["x1", "y1", "x2", "y2"]].to_numpy(float), meta["cell_id"].to_numpy(np.int64), False)
        box = tuple(map(float, (meta.x1.min(), meta.y1.min(), meta.x2.max(), meta.y2.max())))
        for old in ("meta", "data"):
            _remove(spark, f"{path}/{old}")
        _write(rows, path, box, 0)
        _save_bytes(spark, f"{path}/partitioner-0", pickle.dumps(copy))
        _publish(_stats(spark, path, False, 0), path, 0)
        return reorganize(Index(spark, path), cells, None, kind, rows_per_cell)
    version, meta = index.version() + 1, index.meta
    top = (meta.agg(F.max("cell_id")).first()[0] or 0) + 1
    again = index.rows.where(F.col("cell_id").isin(cells)).drop("cell_id")
    box, n, sample = sample_points(again)
    partitioner = P.build(P.NAMED.get(kind, (kind, False))[0], box, -(-n // rows_per_cell) or 1, sample)
    placed = assign(again, partitioner, False).withColumn("cell_id", F.col("cell_id") + top)
    whole = meta.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    _write(placed, index.path, tuple(whole), version)
    new = meta.where(~F.col("cell_id").isin(cells)).unionByName(_stats(spark, index.path, False, version)).toPandas()  # a row per cell
    _save_bytes(spark, f"{index.path}/partitioner-{version}", pickle.dumps(P.Cells(new[["x1", "y1", "x2", "y2"]].to_numpy(float), new["cell_id"].to_numpy(np.int64), False)))
    _publish(spark.createDataFrame(new), index.path, version, True)
    return index


def quality(index: Index, query: float = 0.1) -> float:
    """Expected bytes that a square query of side ``query`` reads, relative to the index's rectangle."""
    m = index.meta
    box = m.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    space = max((box[2] - box[0]) * (box[3] - box[1]), 1e-12)
    return m.agg(F.sum((R.width(R.rect()) + query) * (R.height(R.rect()) + query) * F.col("size"))).first()[0] / space


# Joins of indexes.


def join_indexes(a: Index, b: Index, keep_left: list[str], keep_right: list[str], refine: Column | None = None) -> DataFrame:
    """Pairs of rows of two indexes whose rectangles overlap. Partitions without an overlapping one on the other side aren't read; the rest
    meet on a grid, so that two full cells cost no nested loop. Where an index is replicated a pair counts in the tile of its reference point only."""
    pairs = partition_pairs(a.meta, b.meta)
    sides = []
    for index, p in ((a, "l"), (b, "r")):
        cells = [r[0] for r in pairs.select(f"{p}_cell_id").distinct().collect()]  # a row per cell
        rows = index.rows.where(F.col("cell_id").isin(cells))
        sides.append(rows.join(F.broadcast(index.tiles()), "cell_id") if index.disjoint and not is_point(rows) else rows)
    point = R.reference_point(R.rect("l_"), R.rect("r_"))
    test, more = refine, [["cell_id", "cx1", "cy1", "cx2", "cy2"] if "cx1" in s.columns else [] for s in sides]
    for p, cols in zip(("l_", "r_"), more):
        if cols:
            inside = R.has_point(R.Rect(f"{p}cx1", f"{p}cy1", f"{p}cx2", f"{p}cy2"), *point)
            test = inside if test is None else test & inside
    joined = spatial_join(*sides, list(dict.fromkeys([*keep_left, *more[0]])), list(dict.fromkeys([*keep_right, *more[1]])), test, "grid")
    return joined.select(*[f"l_{c}" for c in keep_left], *[f"r_{c}" for c in keep_right])


def _swept(schema_left: list[str], schema_right: list[str]):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        i, j = sweep.pairs(left[[f"l_{c}" for c in R.BOX]].to_numpy(float), right[[f"r_{c}" for c in R.BOX]].to_numpy(float))
        return pd.concat([left[schema_left].iloc[i].reset_index(drop=True), right[schema_right].iloc[j].reset_index(drop=True)], axis=1)

    return run


def partition_join(left: DataFrame, right: DataFrame, keep_left: list[str], keep_right: list[str], kind: str = "str+", rows_per_cell: int = 20_000, local: str = "sweep", cells: P.Cells | None = None) -> DataFrame:
    """Join of two sets by the cells of any disjoint partitioner, which is built from a sample of both: rows go to all cells that they touch, and a pair
    counts in the cell of its reference point. ``local``: "sweep" sorts the rows of a cell and sweeps them in one task (cells are of bounded size by the
    partitioner); "hash" leaves each cell to Spark's join, which splits skewed ones. ``cells``: a partitioner that is there already (repartition join)."""
    spark = left.sparkSession
    a, b = boxed(left.select(*dict.fromkeys([*keep_left, *_geometry(left)]))), boxed(right.select(*dict.fromkeys([*keep_right, *_geometry(right)])))
    if cells is None:
        box, n, sample = sample_points(a.select(*R.BOX).unionByName(b.select(*R.BOX)))
        cells = P.build(P.NAMED.get(kind, (kind, True))[0], box, -(-n // rows_per_cell) or 1, sample)
    if not cells.disjoint:
        raise ValueError(f"{kind} is no disjoint partitioner")
    tiles = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(cells.ids, cells.boxes)], "l_cell_id long, cx1 double, cy1 double, cx2 double, cy2 double")
    named = lambda df, p: assign(df, cells, True).select(*[F.col(c).alias(f"{p}{c}") for c in [*df.columns, "cell_id"]])
    a, b = named(a, "l_"), named(b, "r_")
    test = _test(is_point(left), is_point(right), None)
    if local == "sweep":
        ca, cb = a.columns, [c for c in b.columns if c != "r_cell_id"]
        schema = StructType([*a.schema.fields, *[f for f in b.schema.fields if f.name in cb]])
        met = a.groupBy("l_cell_id").cogroup(b.groupBy("r_cell_id")).applyInPandas(_swept(ca, cb), schema)
    else:
        met = a.join(b, F.col("l_cell_id") == F.col("r_cell_id"))
    px, py = R.reference_point(R.rect("l_"), R.rect("r_"))
    met = met.where(test).join(F.broadcast(tiles), "l_cell_id").where(R.has_point(R.Rect("cx1", "cy1", "cx2", "cy2"), px, py))
    return met.select(*[f"l_{c}" for c in keep_left], *[f"r_{c}" for c in keep_right])


def _geometry(df: DataFrame) -> list[str]:
    return ["x", "y"] if is_point(df) else list(R.BOX)


def repartition_join(index: Index, other: DataFrame, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """Join of an index with a set that has none: the set is dealt to the index's cells, whose rows stay where they are. A row of an index without replication
    stands in one cell, so its pairs do too; otherwise the reference point decides."""
    if index.disjoint:
        return partition_join(index.rows.drop("cell_id").dropDuplicates(keep_left), other, keep_left, keep_right, cells=index.partitioner())
    rows = index.rows
    a = boxed(rows.select(*dict.fromkeys([*keep_left, *_geometry(rows), "cell_id"])))
    b = boxed(other.select(*dict.fromkeys([*keep_right, *_geometry(other)])))
    b = assign(b, like(index), True)
    a, b = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((a, "l_"), (b, "r_")))
    met = a.join(b, (F.col("l_cell_id") == F.col("r_cell_id")) & _test(is_point(rows), is_point(other), None))
    return met.select(*[f"l_{c}" for c in keep_left], *[f"r_{c}" for c in keep_right])


def choose_join(a: Index, b: Index) -> str:
    """"direct" or "repartition", whichever reads and writes fewer cells: a direct join reads both sides of each pair of partitions; repartitioning
    reads the smaller side, writes it, reads it again (three times its cells) and reads the other side once."""
    direct = 2 * partition_pairs(a.meta, b.meta).count()
    less, more = sorted((a.meta.count(), b.meta.count()))
    return "direct" if direct <= 3 * less + more else "repartition"


def auto_join(a: Index, b: Index, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """By the cheaper way; results are the same."""
    if choose_join(a, b) == "direct":
        return join_indexes(a, b, keep_left, keep_right)
    if a.meta.count() >= b.meta.count():
        return repartition_join(a, b.rows.drop("cell_id").dropDuplicates(keep_right) if b.disjoint else b.rows.drop("cell_id"), keep_left, keep_right)
    turned = repartition_join(b, a.rows.drop("cell_id").dropDuplicates(keep_left) if a.disjoint else a.rows.drop("cell_id"), keep_right, keep_left)
    return _turned(turned, keep_left, keep_right)


def _turned(df: DataFrame, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """Swaps the sides' names."""
    return df.select(*[F.col(f"r_{c}").alias(f"l_{c}") for c in keep_left], *[F.col(f"l_{c}").alias(f"r_{c}") for c in keep_right])
