"""Steps that must grow no faster than their input."""

import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from stratum.kernel import overlay, partition as P, plain, shapes as S
from stratum.operators import geometry as G, index, polygons
from stratum.plans import wide


def test_bulk_splits_that_cut_off_few_points_need_little_memory():
    pts = np.random.default_rng(5).random((20_000, 2)) * [500_000.0, 100_003.0]
    tracemalloc.start()
    cells = P.build("rrstar", (0.0, 0.0, 500_000.0, 100_003.0), 2_000, pts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * pts.nbytes
    assert np.bincount(np.searchsorted(cells.ids, cells.assign(pts[:, 0], pts[:, 1]))).max() <= 10


def _ring(r, corners):
    x, y = r.randrange(12), r.randrange(12)
    pts = [(float(x + r.randrange(7)), float(y + r.randrange(7))) for _ in range(corners)]
    return "POLYGON", [[*pts, pts[0]]]


def test_plain_polygons_together_are_as_one_by_one():
    r = random.Random(1)
    for n, m in ((3, 3), (4, 4), (5, 3)):
        a, b = [_ring(r, n) for _ in range(2000)], [_ring(r, m) for _ in range(2000)]
        (at, c), (_, d) = (next(plain.rings([S.to_wkb(g) for g in x])) for x in (a, b))
        assert len(at) == 2000 and plain.meet(c, d).tolist() == [S.intersects(x, y) for x, y in zip(a, b)]
        assert plain.areas(c).tolist() == [S.area(x) for x in a] and plain.texts(c) == [S.to_wkt(x) for x in a]
        assert [plain.wkb_of(S.to_wkt(x)) for x in a] == [S.to_wkb(x) for x in a]
    assert plain.wkb_of("POLYGON ((0 0, 1 1),(2 2, 3 3))") is None and plain.wkb_of("POLYGON EMPTY") is None


def test_join_of_polygons_that_touch_in_a_corner(spark):
    """Exact tests are closed, so rectangles with a common edge are candidates; those of the filter alone aren't."""
    rows = [(1, "POLYGON ((0 0, 2 2, 4 0, 2 -2, 0 0))"), (2, "POLYGON ((4 0, 6 2, 8 0, 6 -2, 4 0))"), (3, "LINESTRING (8 0, 9 5)"), (4, None)]
    df = G.with_boxes(spark.createDataFrame(rows, "id long, wkt string").select("id", G.from_wkt("wkt").alias("geom")))
    pairs = lambda *a: sorted(map(tuple, G.join_geometries(df, df, ["id"], ["id"], *a, strategy="grid").where("l_id < r_id").collect()))
    assert pairs() == [(1, 2), (2, 3)] and pairs(True) == []


def test_geometries_of_a_narrow_table_are_made_in_many_tasks(spark):
    assert wide.diamonds_part(spark, "/root/testdata/sf0.01").select(F.spark_partition_id()).distinct().count() > 1


def test_union_is_exact_and_quick_for_many_boxes():
    """Far polygons don't count for a piece: three hundred boxes in a row in well under a second each hundred."""
    row = [S.box(2.0 * i, 0.0, 2.0 * i + 3, 3.0) for i in range(300)]
    began = time.process_time()
    assert overlay.union(row) == S.box(0.0, 0.0, 601.0, 3.0)
    assert time.process_time() - began < 3
    third = ("POLYGON", [[(0.0, 0.0), (3.0, 1.0), (3.0, 2.0), (0.0, 0.0)]])
    assert overlay.union([third, ("POLYGON", [[(0.0, 1.0), (3.0, 0.0), (3.0, -1.0), (0.0, 1.0)]])])[0] == "POLYGON"


def test_unions_of_groups_are_dealt_to_many_tasks(spark):
    df = spark.range(40).select((F.col("id") % 20).alias("k"), G.from_wkt(F.lit("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")).alias("geom"))
    assert polygons.union_by(df, "k").select(F.spark_partition_id()).distinct().count() > 1


def test_curve_ranges_hold_equal_shares_of_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SAMPLE_ROWS", 200)
    r = np.random.default_rng(4)
    x, y = r.random(3000) ** 3 * 100, r.random(3000) * 50
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    for kind in ("zcurve", "hilbert"):
        got = index.build_index(df, str(tmp_path / kind), kind, 30).partitioner()
        v = np.sort(got.values(x, y))
        assert got.splits.tolist() == np.unique([v[3000 * k // 100] for k in range(1, 100)]).tolist()


def test_cells_of_a_large_tiling_are_found_without_a_look_at_all():
    r = np.random.default_rng(2)
    pts = r.random((50_000, 2)) * 1000
    for kind in ("kdtree", "str"):
        c = P.build(kind, (0.0, 0.0, 1000.0, 1000.0), 16_000, pts)
        assert c.slots() is None
        c.prepare()
        began = time.process_time()
        x, y = r.random(20_000) * 1100 - 50, r.random(20_000) * 1000
        ids, many = c.assign(x, y), c.overlaps(x, y, x + 5, y + 5)
        assert time.process_time() - began < 5
        assert ids[:200].tolist() == c._nearest(x[:200], y[:200]).tolist()
        b = c.boxes
        for i in range(200):
            assert sorted(many[i]) == sorted(c.ids[(x[i] < b[:, 2]) & (x[i] + 5 > b[:, 0]) & (y[i] < b[:, 3]) & (y[i] + 5 > b[:, 1])])


def test_cells_that_overlap_are_compared_in_bounded_memory():
    r = np.random.default_rng(3)
    b = r.random((5_000, 2)) * 1000
    c = P.Cells(np.hstack([b, b + 1]), np.arange(5_000), False)
    x, y = r.random((2, 1_000)) * 1000
    tracemalloc.start()
    c.assign(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
