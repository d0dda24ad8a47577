"""Pairs by blocks are the pairs of the cell join, row by row."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import counts as N
from tessera.operators import joins as J
from tessera.operators import pairs as P
from tessera.plans import catalog, jobs
from tessera.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _points(spark, n=3000):
    r = random.Random(n)
    rows = [(i if i % 50 else None, float(r.randrange(-80, 80)), r.uniform(-80.0, 80.0)) for i in range(n)]
    rows += [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 0.0, 5.0), (-3, 0.0, 5.0)]
    return spark.createDataFrame(rows, "pid long, x double, y double")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _lines(spark):
    r = random.Random(3)
    lines = [(i % 7, "LINESTRING (" + ", ".join(f"{r.randrange(-70, 70)} {r.randrange(-70, 70)}" for _ in range(r.randrange(2, 9))) + ")") for i in range(20)]
    return J.numbered(jobs.with_geom(spark.createDataFrame([*lines, (77, None), (None, "LINESTRING (0 0, 9 9)")], "id long, wkt string")).select("id", "geom"))


@pytest.mark.parametrize("few", [False, True])
def test_line_pairs_in_blocks(spark, monkeypatch, few):
    """the same rows, repeated points and lines of one ID too, a null ID or value kept."""
    if few:  # blocks go in parts
        monkeypatch.setattr(N, "POINTS_PART", 300)
        monkeypatch.setattr(N, "WINDOWS_PART", 7)
    p, layer = _points(spark), _lines(spark)
    for strict in (True, False):
        want = J.line_buffer_join(p, layer, 12.0, layer=layer, strict=strict)
        got = J.line_buffer_join(p, layer, 12.0, layer=layer, strict=strict, blocks=["distance", "pid", "_wid", "id", "x"])
        assert got.columns == ["distance", "pid", "_wid", "id", "x"]
        assert _rows(got) == _rows(want.select(*got.columns)) and got.count() > 1000
    with pytest.raises(ValueError):
        J.line_buffer_join(p, layer, 12.0, layer=layer, how="left_semi", blocks=["pid"])
    with pytest.raises(ValueError):
        J.line_buffer_join(p, layer, 12.0, layer=layer, blocks=["pid", "no such column"])


def test_polygon_pairs_in_blocks(spark):
    """the same for polygons with holes, their boundary in or out."""
    r = random.Random(4)
    ring = lambda c, d: f"POLYGON (({c - 40} {d - 40}, {c + 40} {d - 35}, {c + 30} {d + 40}, {c} {d}, {c - 40} {d + 40}), ({c + 2} {d - 20}, {c + 12} {d - 20}, {c + 12} {d - 8}, {c + 2} {d - 20}))"
    areas = spark.createDataFrame([(i % 5, ring(r.randrange(-50, 50), r.randrange(-50, 50))) for i in range(15)], "id long, wkt string")
    p, layer = _points(spark), J.numbered(jobs.with_geom(areas).select("id", "geom"), closed=True)
    for boundary in (False, True):
        want = J.polygon_join(p, layer, layer=layer, boundary=boundary).select("id", "pid")
        assert _rows(J.polygon_join(p, layer, layer=layer, boundary=boundary, blocks=["id", "pid"])) == _rows(want) and want.count() > 1000


def test_copies_of_a_road_are_repeated_by_lists(spark):
    """a road that repeats gives its pairs as often; what is repeated are the lists of its points."""
    p = _points(spark).withColumnRenamed("pid", "event_id")
    roads = spark.createDataFrame([(1, "LINESTRING (-50 0, 50 3)")] * 40 + [(2, "LINESTRING (0 -50, 3 50)")], "id long, wkt string")
    out = jobs.road_pairs(p, roads, 10.0)
    want = J.line_buffer_join(p, jobs.with_geom(roads), 10.0).select("id", "event_id")
    assert _rows(out.groupBy("id", "event_id").count()) == _rows(want.groupBy("id", "event_id").count())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(") < plan.index("array_repeat(")  # the plan's lines go from the last step to the first


def test_rows_unroll_to_few():
    """the JVM holds what a row of lists unrolls to: 4 x 10^8 rows of one road come in small lists of few copies."""
    x, y = np.linspace(0.0, 1000.0, 1000), np.full(1000, 5.0)
    points = pa.table({"_px": x, "_py": y, "_point0": range(1000)})
    line = [[{"x1": 0.0, "y1": 0.0, "dx": 1000.0, "dy": 0.0, "l2": 1e6}]]
    for copies in (1, 3, P.UNROLLED, 400_000):
        windows = pa.table({"_window0": [7], "_copies": pa.array([copies], pa.int32()), "_list": line})
        out = list(P._met(N.Line(10.0, True), (0, 0), 1024.0, windows, points, ["_point0"], ["_window0", "_copies"], False))
        rows = [(of, m, at) for b in out for of, m, at in zip(*(c.to_pylist() for c in b), strict=True)]
        assert all(of == 7 and 0 < m * len(at) <= P.UNROLLED for of, m, at in rows)
        n = {}
        for _, m, at in rows:
            for i in at:
                n[i] = n.get(i, 0) + m
        assert n == dict.fromkeys(range(1000), copies)


def test_queries_with_very_many_pairs_go_by_blocks(spark):
    """No join of points with cells makes a row for every candidate."""
    for query, joins in ((catalog.q_road_pairs, 1), (catalog.q_road_pairs_dedupe, 1), (catalog.q_road_pairs_shared, 1), (catalog.q_polygon_members, 1), (catalog.q_line_buffer_cover, 2), (catalog.q_dissolved_buffer_cover, 2)):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == joins and "_e0" not in plan, query.__name__


def test_pairs_leave_in_small_batches(monkeypatch):
    """A task holds the windows and some points of one block at a time."""
    monkeypatch.setattr(P, "PAIRS", 500)
    monkeypatch.setattr(N, "MATRIX", 200)
    monkeypatch.setattr(N, "POINTS_PART", 700)
    r = np.random.default_rng(5)
    n, w, rows = 2000, 12, []
    for cx in (3, 4):
        at = [{"x1": cx * 1024.0 + a, "y1": 1024.0 * 2 + b, "dx": 40.0, "dy": 10.0, "l2": 1700.0} for a, b in r.uniform(100, 900, (w, 2))]
        rows += [{"_cx": cx, "_cy": 2, "_p": 0, "_w": 0, "_side": 0, "_window0": i, "_list": [s]} for i, s in enumerate(at)]
        rows += [{"_cx": cx, "_cy": 2, "_p": 0, "_w": 0, "_side": 1, "_px": cx * 1024.0 + a, "_py": 2048.0 + b, "_point0": i} for i, (a, b) in enumerate(r.uniform(0, 1024, (n, 2)))]
    schema = pa.schema([*[(c, pa.int64()) for c in ("_cx", "_cy", "_p", "_w", "_side", "_window0", "_point0")], ("_px", pa.float64()), ("_py", pa.float64()),
                        ("_list", pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "dx", "dy", "l2")])))])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=300)
    run = P._streamed(N.Line(90.0, True), 1024.0, ["_point0"], ["_window0"], ["id", "pid", "distance"], True)
    out = list(run(iter(batches)))
    assert len(out) > 4 and max(sum(map(len, b["pid"].to_pylist())) for b in out) <= 700 + N.MATRIX
    got = sorted((i, p, round(d, 6)) for b in out for i, ps, ds in zip(*(b[c].to_pylist() for c in ("id", "pid", "distance")), strict=True) for p, d in zip(ps, ds, strict=True))
    want = []
    for block in (rows[: w + n], rows[w + n:]):
        for q in block[w:]:
            for s in block[:w]:
                a, t = s["_list"][0], 0.0
                t = min(1.0, max(0.0, ((q["_px"] - a["x1"]) * a["dx"] + (q["_py"] - a["y1"]) * a["dy"]) / a["l2"]))
                d = np.hypot(q["_px"] - a["x1"] - t * a["dx"], q["_py"] - a["y1"] - t * a["dy"])
                if d < 90.0:
                    want.append((s["_window0"], q["_point0"], round(float(d), 6)))
    assert got == sorted(want) and len(got) > 500


def test_places_in_circles_are_shuffled_once(spark):
    """distinct coordinates go through one shuffle, without their projection, whether circles are broadcast or not."""
    r = random.Random(8)
    rows = [(i, round(116.3 + r.random() / 50, 4), round(39.9 + r.random() / 50, 4)) for i in range(2000)] + [(-1, None, 39.9), (-2, 116.3, 39.9), (-3, 116.3, 39.9)]
    p = FX.with_mercator(spark.createDataFrame(rows, "pid long, lng double, lat double"))
    pois = spark.createDataFrame([(116.3 + i / 1000, 39.9) for i in (0, 0, 3, 9)], "lng double, lat double")
    want = jobs.poi_circle_pairs(jobs.places(p), pois, 400.0).select("poi_lng", "poi_lat", "lng", "lat")
    for opts, keys in (({}, "lng"), ({"broadcast_bytes": 0}, "_cx")):
        got = jobs.poi_circle_pairs(p, pois, 400.0, distinct=True, **opts).select(*want.columns)
        assert _rows(got) == _rows(want) and got.count() > 100
        plan = got._jdf.queryExecution().executedPlan().toString()
        of_points = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "poi_" not in x and (f"({keys}#" in x)]
        assert len(of_points) >= 1 and plan.count("HashAggregate(keys=[lng#") == 2
        assert "Exchange hashpartitioning(lng" not in plan or not opts
