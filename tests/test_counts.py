"""Counts without pairs are the counts of the joins' pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.tiles import EQUATOR
from tessera.operators import aggs as A
from tessera.operators import cells as C
from tessera.operators import counts as N
from tessera.operators import joins as J
from tessera.operators import raster as R
from tessera.plans import jobs

DAYS = ("2024-01-01", "2024-01-02", None)


def _points(spark, n=4000, grid=None):
    r = random.Random(n)
    at = lambda: float(r.randrange(-80, 80)) if grid else r.uniform(-80.0, 80.0)
    rows = [(i, at(), at(), r.choice(DAYS)) for i in range(n)] + [(-1, None, 1.0, DAYS[0])] + [(n + i, 0.0, 5.0, DAYS[1]) for i in range(500)]
    return spark.createDataFrame(rows, "pid long, x double, y double, date string")


def _pairs(df, *keys):
    return sorted(map(tuple, df.groupBy(*keys).agg(F.count(F.lit(1))).collect()), key=str)


def _found(df, *keys):
    return sorted(map(tuple, df.select(*keys, "n").collect()), key=str)


@pytest.mark.parametrize("grid", [False, True])
def test_counts_are_those_of_the_pairs(spark, monkeypatch, grid):
    if grid:  # a crowded block goes in parts
        monkeypatch.setattr(N, "POINTS_PART", 300)
        monkeypatch.setattr(N, "WINDOWS_PART", 7)
    for edge in (grid,):
        p, r = _points(spark, grid=grid), random.Random(3)
        pos = spark.createDataFrame([(i, float(r.randrange(-70, 70)), float(r.randrange(-70, 70))) for i in range(30)] + [(99, None, 0.0)], "poi long, wx double, wy double")
        for inclusive in (edge,):
            want = _pairs(J.distance_join(p, pos, 25.0, window_xy=("wx", "wy"), inclusive=inclusive), "poi", "date")
            assert _found(N.distance_counts(p, pos, 25.0, by="date", window_xy=("wx", "wy"), inclusive=inclusive), "poi", "date") == want
        lines = [(i, "LINESTRING (" + ", ".join(f"{r.randrange(-70, 70)} {r.randrange(-70, 70)}" for _ in range(r.randrange(2, 9))) + ")") for i in range(20)]
        layer = J.numbered(jobs.with_geom(spark.createDataFrame([*lines, (77, None)], "id long, wkt string")).select("id", "geom"))
        for strict in (not edge,):
            want = _pairs(J.line_buffer_join(p, layer, 12.0, layer=layer, strict=strict), "id", "date")
            assert _found(N.line_buffer_counts(p, layer, 12.0, by="date", strict=strict), "id", "date") == want
        rings = lambda c, d: f"POLYGON (({c - 40} {d - 40}, {c + 40} {d - 35}, {c + 30} {d + 40}, {c} {d}, {c - 40} {d + 40}), ({c + 2} {d - 20}, {c + 12} {d - 20}, {c + 12} {d - 8}, {c + 2} {d - 20}))"
        areas = spark.createDataFrame([(i, rings(r.randrange(-50, 50), r.randrange(-50, 50))) for i in range(15)], "id long, wkt string")
        layer = J.numbered(jobs.with_geom(areas).select("id", "geom"), closed=True)
        for boundary in (edge,):
            want = _pairs(J.polygon_join(p, layer, layer=layer, boundary=boundary), "id")
            assert _found(N.polygon_counts(p, layer, boundary=boundary), "id") == want


def test_equal_windows_are_met_once(spark):
    roads = spark.range(100_000).select((F.col("id") % 2).alias("id"), F.lit("LINESTRING (-50 0, 50 3)").alias("wkt"))
    p = _points(spark).withColumns({"lng": F.col("x"), "lat": F.col("y"), "event_id": F.col("pid"), "sys_ms": F.lit(1704067200000)})
    one = jobs.with_geom(spark.createDataFrame([(0, "LINESTRING (-50 0, 50 3)")], "id long, wkt string"))
    near = J.line_buffer_join(p, one, 10.0).count()
    assert sorted(r["count"] for r in jobs.road_daily_counts(p, roads, 10.0).collect()) == [near * 50_000] * 2  # 10^8 pairs
    places = J.line_buffer_join(p.select("lng", "lat", "x", "y").distinct(), one, 10.0).count()
    assert jobs.road_members(p, roads, 10.0).count() == jobs.road_pairs(p, roads, 10.0, dedupe=True).count() == 2 * places
    assert jobs.road_pairs(p, roads.filter("id = 0").limit(10), 10.0).count() == 10 * near


def test_members_of_distinct_sides_need_no_shuffle(spark):
    p = _points(spark).withColumns({"lng": F.col("x"), "lat": F.col("y")})
    pois = spark.createDataFrame([(116.2, 39.9), (116.2, 39.9), (0.0, 0.0)], "lng double, lat double")
    pairs = jobs.poi_circle_pairs(jobs.places(p), pois, 60.0)
    members = A.join_members(pairs, ["poi_lng", "poi_lat"], ["lng", "lat"], unique=True)
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, A.join_members(pairs, ["poi_lng", "poi_lat"], ["lng", "lat"]).collect())) and members.count() > 100


def test_polygon_members_are_pairs_of_distinct_sides(spark):
    square = lambda c, r: f"POLYGON (({c - r} {-r}, {c + r} {-r}, {c + r} {r}, {c - r} {r}, {c - r} {-r}))"
    p = _points(spark, grid=True).withColumns({"lng": F.col("x"), "lat": F.col("y")})
    once = [(1, square(0, 30)), (1, square(0, 30)), (2, square(10, 20))]
    shared = [(3, square(-5, 30)), (3, square(15, 30)), (None, square(0, 10)), (None, square(3, 10))]  # polygons of one ID overlap
    for rows in (once, once + shared):
        areas = spark.createDataFrame(rows, "id long, wkt string")
        want = A.join_members(J.polygon_join(p.select("lng", "lat", "x", "y"), jobs.with_geom(areas)), ["id"], ["lng", "lat"])
        got = jobs.area_members(p, areas)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = jobs.area_members(p, spark.createDataFrame(once, "id long, wkt string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan and "Aggregate [lng" in plan  # points are made distinct, pairs are not


def test_windows_are_parsed_by_all_tasks(spark):
    roads = spark.range(40).coalesce(1).select("id", F.lit("LINESTRING (-50 0, 50 3)").alias("wkt"))
    assert C.dealt(roads).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert len(jobs.road_layer(roads).select(F.input_file_name()).distinct().collect()) > 1


def test_line_pixels_shuffle_pieces_not_pixels(spark):
    r = random.Random(4)
    ends = [tuple(r.uniform(-3e5, 3e5) for _ in range(4)) for _ in range(12)] + [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, -4e5, 1.0)]
    lines = jobs.with_geom(spark.createDataFrame([(f"LINESTRING ({a!r} {b!r}, {c!r} {d!r})",) for a, b, c, d in ends], "wkt string"))
    want = set()
    for z in (9, 11):
        scale = 2.0 ** z * 256.0
        for a, b, c, d in ends:
            x1, x2 = ((v + EQUATOR / 2.0) / EQUATOR * scale for v in (a, c))
            y1, y2 = ((EQUATOR / 2.0 - v) / EQUATOR * scale for v in (b, d))
            n = math.ceil(max(abs(x2 - x1), abs(y2 - y1)))
            for k in range(n + 1):
                gx, gy = (math.floor(u + (v - u) * k / n) if n else math.floor(u) for u, v in ((x1, x2), (y1, y2)))
                want.add((z, gx // 256, gy // 256, gx % 256, gy % 256))
    out = R.line_pixels(lines, 9, 11, geom_col="geom")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(z" in plan and "tx#" in plan.split("Exchange hashpartitioning")[1].split(")")[0]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] != 10} == want
