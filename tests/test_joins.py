"""Cell equi-joins against brute force, including the shuffle/salt and
multi-level paths, exact-radius and cell-edge cases."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import geom as G
from tessera.operators import joins as J
from tessera.plans import jobs
from tessera.sources import fixtures as FX


def rnd_points(seed, n, lo=-500.0, hi=500.0, grid=None):
    r = random.Random(seed)
    pts = []
    for i in range(n):
        x, y = r.uniform(lo, hi), r.uniform(lo, hi)
        if grid:
            x, y = round(x / grid) * grid, round(y / grid) * grid
        pts.append((i, x, y))
    return pts


def brute_pairs(pts, wins, r, inclusive=True):
    out = set()
    for i, x, y in pts:
        for j, wx, wy in wins:
            d = math.sqrt((x - wx) ** 2 + (y - wy) ** 2)
            if d <= r if inclusive else d < r:
                out.add((i, j))
    return out


@settings(max_examples=6, deadline=None)
@given(seed=st.integers(0, 10_000), radius=st.sampled_from([7.0, 25.0, 100.0]), grid=st.sampled_from([None, 5.0]),
       cell=st.sampled_from([None, 1.7]))
def test_distance_join_equals_brute_force(spark, seed, radius, grid, cell):
    pts = rnd_points(seed, 300, grid=grid)
    wins = rnd_points(seed + 1, 40, grid=grid)
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    w = spark.createDataFrame(wins, "wid long, x double, y double")
    cs = None if cell is None else radius * cell
    for inclusive in (True, False):
        got = {(r.pid, r.wid) for r in J.distance_join(p, w, radius, inclusive=inclusive, cell_size=cs).collect()}
        assert got == brute_pairs(pts, wins, radius, inclusive)


def test_distance_exactly_r_inclusive_vs_strict(spark):
    p = spark.createDataFrame([(1, 3.0, 4.0), (2, -3.0, -4.0), (3, 10.0, 0.0)], "pid long, x double, y double")
    w = spark.createDataFrame([(9, 0.0, 0.0)], "wid long, x double, y double")
    inc = sorted(r.pid for r in J.distance_join(p, w, 5.0).collect())
    strict = sorted(r.pid for r in J.distance_join(p, w, 5.0, inclusive=False).collect())
    assert inc == [1, 2] and strict == []


def test_distance_join_shuffle_and_salt_paths(spark):
    # a third of the points sit in one cell: the hot-cell path must give the same pairs
    r = random.Random(3)
    pts = [(i, r.uniform(0, 9), r.uniform(0, 9)) for i in range(200)] + rnd_points(5, 400)
    pts = [(i, x, y) for i, (_, x, y) in enumerate(pts)]
    wins = rnd_points(6, 30) + [(100, 5.0, 5.0)]
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    w = spark.createDataFrame(wins, "wid long, x double, y double")
    want = brute_pairs(pts, wins, 10.0)
    for opts in (dict(), dict(broadcast_bytes=0), dict(broadcast_bytes=0, salt=True, hot_rows=50)):
        got = {(x.pid, x.wid) for x in J.distance_join(p, w, 10.0, **opts).collect()}
        assert got == want, opts


def test_distance_join_time_band(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 100), (2, 0.0, 0.0, 250), (3, 1.0, 0.0, 50), (4, 50.0, 0.0, 100)],
                              "pid long, x double, y double, t long")
    w = spark.createDataFrame([(9, 0.0, 0.0, 50, 200)], "wid long, x double, y double, lo long, hi long")
    got = sorted(r.pid for r in J.distance_join(p, w, 5.0, band=dict(point_col="t", lo="lo", hi="hi", bucket=60)).collect())
    assert got == [1, 3]


def _brute_line(pts, lines, r):
    out = set()
    for i, x, y in pts:
        for lid, verts in lines:
            d = min(_seg_d(x, y, a, b) for a, b in zip(verts, verts[1:]))
            if d < r:
                out.add((lid, i))
    return out


def _seg_d(px, py, a, b):
    (x1, y1), (x2, y2) = a, b
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / l2))
    return math.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


@pytest.mark.parametrize("opts", [dict(), dict(broadcast_bytes=0, salt=True, hot_rows=5), dict(cell_size=3.0)])
def test_line_buffer_join_equals_brute_force(spark, opts):
    r = random.Random(11)
    lines = []
    for lid in range(25):
        x, y = r.uniform(-400, 400), r.uniform(-400, 400)
        verts = [(x, y)]
        for _ in range(r.randint(1, 5)):
            x, y = x + r.uniform(-150, 150), y + r.uniform(-150, 150)
            verts.append((x, y))
        if lid == 0:
            verts = [(0.0, 0.0), (0.0, 0.0)]          # zero-length segment
        lines.append((lid, verts))
    pts = rnd_points(12, 500)
    wkt = [(lid, "LINESTRING (" + ", ".join(f"{x!r} {y!r}" for x, y in v) + ")") for lid, v in lines]
    L = spark.createDataFrame(wkt, "id long, wkt string").select("id", G.geom_from_wkt(F.col("wkt")).alias("geom"))
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    got = {(x.id, x.pid) for x in J.line_buffer_join(p, L, 30.0, **opts).collect()}
    assert got == _brute_line(pts, lines, 30.0)


def test_line_with_many_segments_in_a_cell(spark):
    # more segments than plain columns: the rest goes by the array
    verts = [(math.cos(k / 5) * (20 + k / 3), math.sin(k / 5) * (20 + k / 3)) for k in range(60)]
    wkt = "LINESTRING (" + ", ".join(f"{x!r} {y!r}" for x, y in verts) + ")"
    L = spark.createDataFrame([(1, wkt)], "id long, wkt string").select("id", G.geom_from_wkt(F.col("wkt")).alias("geom"))
    pts = rnd_points(13, 500, -60, 60)
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    got = {(x.id, x.pid): x.distance for x in J.line_buffer_join(p, L, 3.0, cell_size=60.0).collect()}
    assert got.keys() == _brute_line(pts, [(1, verts)], 3.0)


def test_lines_of_one_id_stay_two(spark):
    L = spark.createDataFrame([(1, "LINESTRING (0 0, 10 0)"), (1, "LINESTRING (0 1, 10 1)")], "id long, wkt string")
    p = spark.createDataFrame([(7, 0.0, 0.0, 5.0, 0.5, 5)], "event_id long, lng double, lat double, x double, y double, sys_ms long")
    assert jobs.road_pairs(p, L, 2.0).count() == 2 and jobs.road_pairs(p, L, 2.0, dedupe=True).count() == 1
    assert jobs.road_daily_counts(p, L, 2.0).first()["count"] == 2


def test_pois_at_one_place_are_one_window(spark):
    pois = spark.createDataFrame([(1, 116.3, 39.9), (2, 116.3, 39.9)], "objectid long, lng double, lat double")
    p = FX.with_mercator(spark.createDataFrame([(116.3, 39.9), (116.3, 39.9)], "lng double, lat double"))
    assert [r.n for r in jobs.poi_circle_counts(p, pois, 10.0).collect()] == [1]


def test_replaced_file_is_read_anew(spark, tmpdir_path):
    p = spark.createDataFrame([(7, 5.0, 0.5)], "event_id long, x double, y double")
    for wkt, want in (("LINESTRING (0 0, 10 0)", 1), ("LINESTRING (0 90, 10 90)", 0)):
        spark.createDataFrame([(1, wkt)], "id long, wkt string").write.mode("overwrite").parquet(f"{tmpdir_path}/roads")
        roads = jobs.with_geom(spark.read.parquet(f"{tmpdir_path}/roads"))
        assert J.line_buffer_join(p, roads, 2.0).count() == want
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_points_are_read_once_and_not_replicated(spark, tmpdir_path):
    # small areas and one outline over all of them
    polys = [(i, _square(i * 30.0, 0.0, 10.0)) for i in range(50)] + [(99, _square(700.0, 0.0, 5000.0))]
    df = jobs.with_geom(spark.createDataFrame(polys, "pid_poly long, wkt string")).drop("wkt")
    spark.createDataFrame(rnd_points(3, 200), "pid long, x double, y double").write.parquet(f"{tmpdir_path}/pts")
    for opts in ({}, {"broadcast_bytes": 0}):
        out = J.polygon_join(spark.read.parquet(f"{tmpdir_path}/pts"), df, **opts)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("/pts") == 1 and "Generate explode" not in plan
        assert ("BroadcastHashJoin" in plan) == (not opts)


def test_large_polygon_is_not_broadcast(spark):
    n = 100_000
    ring = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    wkt = "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*ring, ring[0]]) + "))"
    df = jobs.with_geom(spark.createDataFrame([(1, wkt)], "poly long, wkt string")).select("poly", "geom")
    pts = rnd_points(9, 2000, -1200, 1200)
    out = J.polygon_join(spark.createDataFrame(pts, "pid long, x double, y double"), df, cell_size=50.0, broadcast_bytes=4 << 20)
    assert "_segs" not in out.columns and "geom" not in out.columns
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.pid for r in out.collect()} == {i for i, x, y in pts if math.hypot(x, y) < 1000}


def test_buffer_areas_within_the_stated_bound(spark):
    layer = J.numbered(jobs.with_geom(spark.createDataFrame([
        (1, "LINESTRING (0 0, 0 0)"), (2, "LINESTRING (0 0, 300 0)"), (3, "LINESTRING (0 0, 0 5000)"), (4, "LINESTRING (0 0, 200 150, 0 0)"),
        (5, "LINESTRING (0 0, 100 0, 100 100, 0 100, 0 0)")], "id long, wkt string")).select("id", "geom"))
    r = 50.0
    disc, want = math.pi * r * r, {}
    want[1], want[2], want[3], want[4] = disc, disc + 300 * 2 * r, disc + 5000 * 2 * r, disc + 250 * 2 * r
    want[5] = disc + 4 * 100 * r + 100 * 100     # the square with rounded edges, its inside wholly covered
    got = {x.id: x.area for x in J.line_buffer_areas(layer, r).join(layer, "_wid").collect()}
    assert all(abs(got[k] / want[k] - 1) < 0.002 for k in want)


def test_line_join_collapses_segment_hits(spark):
    # a point near the shared vertex of two segments is one (line, point) pair
    L = spark.createDataFrame([(1, "LINESTRING (0 0, 10 0, 10 10)")], "id long, wkt string") \
        .select("id", G.geom_from_wkt(F.col("wkt")).alias("geom"))
    p = spark.createDataFrame([(1, 9.0, 1.0)], "pid long, x double, y double")
    assert J.line_buffer_join(p, L, 5.0).count() == 1


def _square(cx, cy, h):
    return f"POLYGON (({cx - h} {cy - h}, {cx + h} {cy - h}, {cx + h} {cy + h}, {cx - h} {cy + h}, {cx - h} {cy - h}))"


@pytest.mark.parametrize("opts", [dict(), dict(broadcast_bytes=0, salt=True, hot_rows=3), dict(cell_size=7.0)])
def test_polygon_join_equals_brute_force(spark, opts):
    r = random.Random(21)
    polys = [(i, r.uniform(-300, 300), r.uniform(-300, 300), r.choice([10.0, 40.0, 90.0])) for i in range(30)]
    polys.append((99, 0.0, 0.0, 2000.0))                 # one huge polygon in a layer of small ones
    pts = rnd_points(22, 600, grid=10.0)                 # many points on square edges
    df = spark.createDataFrame([(i, _square(cx, cy, h)) for i, cx, cy, h in polys], "pid_poly long, wkt string") \
        .select("pid_poly", G.geom_from_wkt(F.col("wkt")).alias("geom"))
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    want = {(i, j) for j, x, y in pts for i, cx, cy, h in polys if abs(x - cx) < h and abs(y - cy) < h}
    got = {(x.pid_poly, x.pid) for x in J.polygon_join(p, df, **opts).collect()}
    assert got == want
    want_b = {(i, j) for j, x, y in pts for i, cx, cy, h in polys if abs(x - cx) <= h and abs(y - cy) <= h}
    got_b = {(x.pid_poly, x.pid) for x in J.polygon_join(p, df, boundary=True, **opts).collect()}
    assert got_b == want_b


def test_regular_grid_join_strict_edges(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, -0.5, 0.5), (4, 2.5, 1.5)], "pid long, x double, y double")
    got = {(r.pid, r.oid) for r in J.regular_grid_join(p, x0=0, y0=0, cell=1.0, nx=3, ny=2).collect()}
    assert got == {(1, 0), (4, 5)}


def _py_inside(x, y, ring):
    c, on = False, False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) \
                and min(y1, y2) <= y <= max(y1, y2):
            on = True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            c = not c
    return c and not on


@pytest.mark.parametrize("cell", [5.0, 13.0, None])
def test_concave_polygon_interior_cells(spark, cell):
    # a large concave star: with small cells most cells are interior and skip the test
    import math as m
    ring = []
    for k in range(16):
        rad = 100.0 if k % 2 == 0 else 35.0
        ring.append((round(rad * m.cos(k * m.pi / 8), 3), round(rad * m.sin(k * m.pi / 8), 3)))
    ring.append(ring[0])
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + "))"
    polys = spark.createDataFrame([(1, wkt)], "poly long, wkt string").select("poly", G.geom_from_wkt(F.col("wkt")).alias("geom"))
    pts = rnd_points(33, 3000, lo=-110, hi=110) + [(5000 + i, x, y) for i, (x, y) in enumerate(ring)]
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    got = {r.pid for r in J.polygon_join(p, polys, cell_size=cell).collect()}
    want = {i for i, x, y in pts if _py_inside(x, y, ring)}
    assert got == want and len(want) > 300


# ---- polygon cells by running parity ---------------------------------------------------

def _wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")"


def _even_odd(x, y, rings, boundary=False):
    c, on = False, False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            on |= (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                c = not c
    return (c or on) if boundary else (c and not on)


def _random_rings(r, grid):
    """Rings of any shape, self-crossing and with edges along the lines of cells."""
    rings = []
    for _ in range(r.randint(1, 3)):
        n = r.randint(3, 9)
        pts = [(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(n)]
        if grid:
            pts = [(round(x / grid) * grid, round(y / grid) * grid) for x, y in pts]
        rings.append([*pts, pts[0]])
    return rings


@settings(max_examples=10, deadline=None)
@given(seed=st.integers(0, 10 ** 6), grid=st.sampled_from([None, 1.0, 8.0]), cell=st.sampled_from([3.7, 8.0, 16.0, 200.0, None]), move=st.sampled_from([0.0, 12_935_000.0]))
def test_polygon_join_of_any_rings_equals_brute_force(spark, seed, grid, cell, move):
    r = random.Random(seed)
    polys = [(i, [[(x + move, y + move) for x, y in ring] for ring in _random_rings(r, grid)]) for i in range(12)]
    pts = [(i, x + move, y + move) for i, x, y in rnd_points(seed + 1, 250, -70, 70, grid=grid and grid / 2)]
    pts += [(1000 + k, x, y) for k, (x, y) in enumerate(v for _, rings in polys[:4] for v in rings[0])]
    df = jobs.with_geom(spark.createDataFrame([(i, _wkt(rings)) for i, rings in polys], "poly long, wkt string")).select("poly", "geom")
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    for boundary in (False, True):
        got = {(x.poly, x.pid) for x in J.polygon_join(p, df, boundary=boundary, cell_size=cell).collect()}
        assert got == {(i, j) for j, x, y in pts for i, rings in polys if _even_odd(x, y, rings, boundary)}


def test_flat_edges_and_open_rings(spark):
    flat = [[(0.0, 7.999999), (100000.0, 8.000001), (50000.0, 30.0), (0.0, 7.999999)]]  # its edge crosses a line of cells at a slant of 2e-11
    open_ = "POLYGON ((0 0, 10 0, 10 10, 0 10))"
    df = jobs.with_geom(spark.createDataFrame([(1, _wkt(flat)), (2, open_)], "poly long, wkt string")).select("poly", "geom")
    r = random.Random(4)
    pts = [(i, r.uniform(-100, 100100), 8.0 + r.choice([-1, 1]) * 10.0 ** r.uniform(-7, 1)) for i in range(1500)]
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    ring2 = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    for cell in (8.0, 64.0):
        got = {(x.poly, x.pid) for x in J.polygon_join(p, df, cell_size=cell).collect()}
        assert got == {(i, j) for j, x, y in pts for i, rings in ((1, flat), (2, [ring2])) if _even_odd(x, y, rings)}


def test_polygon_cells_are_bounded_by_touched_and_inner_cells(spark):
    # small squares and one outline of many vertices: an edge goes to the cells it touches, not to all left of it
    side, n = 10.0, 4000
    squares = [(i, [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]) for i in range(2000) for x, y in [((i % 50) * 20.0 + 0.3, (i // 50) * 20.0 + 0.3)]]
    ring = [(500 + 480 * math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), 400 + 390 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    polys = [*squares, (9999, [[*ring, ring[0]]])]
    layer = J.numbered(jobs.with_geom(spark.createDataFrame([(i, _wkt(r)) for i, r in polys], "poly long, wkt string")).select("poly", "geom"), closed=True)
    size = 8.0
    touches = J.edge_touches(layer, size)
    n_touches, n_cells = touches.count(), touches.select("_wid", "_cx", "_cy").distinct().count()
    assert n_touches <= 2.2 * (2000 * 4 + n)  # a short edge touches one to four cells
    cells = J.polygon_cells(layer, size)
    inner = cells.filter("size(_list) = 0").count()
    assert cells.count() == n_cells + inner
    assert inner <= math.pi * 480 * 390 / size ** 2 + 2000 * 4
    assert cells.select("_wid", "_cx", "_cy").distinct().count() == n_cells + inner


def test_measured_counts_nested_columns(spark):
    from tessera.operators import cells as C
    ring = "POLYGON ((" + ", ".join(f"{k} {k * k % 97}" for k in range(20_000)) + ", 0 0))"
    df = jobs.with_geom(spark.createDataFrame([(1, ring, {"a": "x" * 1000}, [["y" * 500], None])], "id long, wkt string, m map<string,string>, l array<array<string>>"))
    base = C.measured(df.select("id"))[0]
    assert C.measured(df.select("id", "geom"))[0] - base > 20_000 * 16
    assert C.measured(df.select("id", "m"))[0] - base > 1000 and C.measured(df.select("id", "l"))[0] - base > 500
    assert C.measured(df.limit(0), "l") == (0, 0)
    pts = spark.createDataFrame([(7, 1.0, 1.0)], "pid long, x double, y double")
    w = df.select("id", "geom", F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"))
    wide = J.distance_join(pts, w, 5.0, window_xy=("wx", "wy"), broadcast_bytes=1 << 20)
    assert "BroadcastHashJoin" not in wide._jdf.queryExecution().executedPlan().toString() and wide.count() == 1
