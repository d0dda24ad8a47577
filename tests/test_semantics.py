"""One test per rule of SURVEY §2.11 that has a rule, plus reference
behaviours the jobs must keep (open bounds, multiplicity, hour boundary)."""

from pyspark.sql import functions as F

from tessera.functions import timefns as TF
from tessera.operators import aggs as A
from tessera.operators import filters as P
from tessera.plans import catalog, jobs

DAY = 86_400_000


def pts(spark, rows):
    rows = [(a, float(b), float(c), float(d), float(e), f, g) for a, b, c, d, e, f, g in rows]
    return spark.createDataFrame(rows, "event_id long, lng double, lat double, x double, y double, sys_ms long, area_code string")


def test_time_range_open_both_ends(spark):
    base = TF.to_ms_literal("2024-01-01")
    df = pts(spark, [(1, 0, 0, 0, 0, base, "a"), (2, 0, 0, 0, 0, base + 1, "a"), (3, 0, 0, 0, 0, base + DAY, "a")])
    assert sorted(r.event_id for r in P.time_range(df, "2024-01-01", "2024-01-02").collect()) == [2]
    assert sorted(r.event_id for r in P.time_range(df, "2024-01-01", "2024-01-02", closed="both").collect()) == [1, 2, 3]
    # whole_days snaps bounds to midnight like the reference's yyyy-MM-dd bounds
    assert sorted(r.event_id for r in P.time_range(df, "2024-01-01 10:00:00", "2024-01-02 05:00:00",
                                                   whole_days=True).collect()) == [2]


def test_winter_sets_both_variants(spark):
    dec = TF.to_ms_literal("2023-12-05")
    nov = TF.to_ms_literal("2023-11-05")
    df = pts(spark, [(1, 0, 0, 0, 0, dec, "110101"), (2, 0, 0, 0, 0, nov, "110101"), (3, 0, 0, 0, 0, 0, "110101"),
                     (4, 0, 0, 0, 0, dec, "999999"), (5, 0, 0, 0, 0, dec, "110120")])
    a = sorted(r.event_id for r in P.season_filter(df, catalog.WINTER, catalog.AREA_CODES_11).collect())
    b = sorted(r.event_id for r in P.season_filter(df, catalog.WINTER_ALT, catalog.AREA_CODES_10).collect())
    assert a == [1, 5] and b == [2]


def test_string_date_bound_excludes_its_day(spark):
    d = spark.createDataFrame([("2017-11-15-23:59:59",), ("2017-11-16-00:00:00",), ("2017-11-16",)], "date string")
    got = [r.date for r in P.date_text_at_most(d, "date", "2017-11-16").collect()]
    assert got == ["2017-11-15-23:59:59", "2017-11-16"]


def test_counts_per_second_skips_null_and_sorts(spark):
    df = spark.createDataFrame([(1000,), (1000,), (None,), (2000,)], "sys_ms long")
    rows = A.counts_per_second(df, upper=None).collect()
    assert [(r.date, r["count"]) for r in rows] == [(None, 0), ("1970-01-01-00:00:01", 2), ("1970-01-01-00:00:02", 1)]


def test_equal_grid_hour_boundary_and_zero_fill(spark):
    h0 = TF.to_ms_literal("2024-01-01")
    env = (0.0, 0.0, 2.0, 2.0)
    df = pts(spark, [(1, 0.5, 0.5, 0, 0, h0 + 10, "a"), (2, 2.0, 2.0, 0, 0, h0 + 20, "a"),   # max edge → last cell
                     (3, 0.5, 0.5, 0, 0, h0 + 3_600_000, "a"),                                # exactly on the hour: dropped
                     (4, 5.0, 5.0, 0, 0, h0 + 30, "a")])                                      # outside the envelope
    rows = sorted(tuple(r) for r in A.equal_grid_hourly_counts(df, "2024-01-01", "2024-01-01T03:00:00", env, 2, 2).collect())
    assert rows == [("2024-01-01-00", 0, 1), ("2024-01-01-00", 1, 0), ("2024-01-01-00", 2, 0), ("2024-01-01-00", 3, 1)]


def test_exposure_counts_multiply_per_case(spark):
    base = TF.to_ms_literal("2024-01-10")
    points = pts(spark, [(1, 116.3, 39.9, 100.0, 100.0, base + 5, "a")])
    pois = spark.createDataFrame([(7, 0.0, 0.0)], "objectid long, x double, y double")
    cases = spark.createDataFrame([("2024-01-05", 10.0, 0.0), ("2024-01-12", 0.0, 10.0), ("2024-02-01", 0.0, 0.0)],
                                  "date string, x double, y double")
    out = jobs.exposure_counts(points, pois, cases, radius=200.0, radius2=50.0, start="2024-01-01", end="2024-02-10")
    assert [(r.objectid, r.date, r.join_count) for r in out.collect()] == [(7, "2024-01-10", 2)]


def test_labeled_area_point_in_two_areas_counts_twice(spark):
    h8 = TF.to_ms_literal("2024-01-03T08:30:00")
    points = pts(spark, [(1, 116.3, 39.9, 5.0, 5.0, h8, "a"), (2, 116.3, 39.9, 5.0, 5.0, h8 - 3_600_000, "a")])
    areas = spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"), (2, "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))")],
                                  "id long, wkt string")
    out = jobs.labeled_area_counts(points, areas, "2024-01-01", "2024-01-31").collect()
    assert [(r.date, r.join_count) for r in out] == [("2024-01-03", 2)]


def test_fishnet_daily_drops_midnight(spark):
    day = TF.to_ms_literal("2024-01-03")
    points = pts(spark, [(1, 0, 0, 5.0, 5.0, day, "a"), (2, 0, 0, 5.0, 5.0, day + 1, "a")])
    net = spark.createDataFrame([(0, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")], "oid long, wkt string")
    a = jobs.fishnet_daily_counts(points, net, "2024-01-01", "2024-01-10").collect()
    b = jobs.fishnet_daily_counts(points, net, "2024-01-01", "2024-01-10", drop_boundary=False).collect()
    assert [r.join_count for r in a] == [1] and [r.join_count for r in b] == [2]


def test_road_pairs_dedupe_vs_duplicates(spark):
    points = pts(spark, [(1, 116.3, 39.9, 1.0, 1.0, 5, "a"), (2, 116.3, 39.9, 1.0, 1.0, 6, "a")])
    roads = spark.createDataFrame([(1, "LINESTRING (0 0, 10 0)")], "id long, wkt string")
    assert jobs.road_pairs(points, roads, 5.0, dedupe=True).count() == 1
    assert jobs.road_pairs(points, roads, 5.0, dedupe=False).count() == 2


def test_axis_order_x_is_longitude(spark):
    from tessera.sources.fixtures import with_mercator
    df = with_mercator(spark.createDataFrame([(116.3, 39.9)], "lng double, lat double")).first()
    assert df.x > 1.29e7 and df.y < 5e6


def test_defaults_drop_nothing(spark):
    """Calls without bounds keep every row, and a column that happens to be called ts is not read."""
    import datetime as dt
    far = TF.to_ms_literal("2031-05-05")
    df = spark.createDataFrame([(1, 5.0, 5.0, 0.0, 0.0, far, "x", dt.datetime(1970, 1, 1))],
                               "event_id long, lng double, lat double, x double, y double, sys_ms long, area_code string, ts timestamp_ntz")
    assert A.counts_per_second(df).count() == 1
    assert P.time_range(df, "2031-01-01", "2032-01-01").count() == 1 and P.time_range(df).count() == 1
    assert P.season_filter(df, (5,), None).count() == 1
    pois = spark.createDataFrame([(7, 0.0, 0.0)], "objectid long, x double, y double")
    assert jobs.poi_daily_counts(df, pois, 10.0).count() == 1
