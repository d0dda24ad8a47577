"""Registered queries (one per operator of SURVEY §2) and their SQL oracles.

Each query takes ``(spark, sf_dir)``, reads the whole supplied tables, derives
the spatial fixtures (``tessera.sources.fixtures``) and runs one operator or
job. ``ORACLE`` holds, for the same key, brute-force DuckDB SQL over the same
tables: cross joins and closed-form predicates, no cells, so the engine's
cell logic is checked against an independent formulation. Column names and
types are aligned on both sides; projected coordinates and other
transcendental results are rounded, since engines differ in the last bits.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import crs, geohash, sqlfuncs, tiles
from ..functions import geom as G
from ..functions import timefns as TF
from ..operators import aggs as A
from ..operators import buffers
from ..operators import cells as C
from ..operators import filters as P
from ..operators import joins as J
from ..operators import ranking
from ..operators import raster as R
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import readers, shapes, sinks
from . import jobs

# ---- fixed values ----------------------------------------------------------------
# Workload values of the queries: season month sets, area-code sets, the bounding
# box (lng/lat, strict), station categories, the envelope of the equal grid.
SPRING = (3, 4, 5)
SUMMER = (6, 7, 8)
AUTUMN = (9, 10, 11)
WINTER = (12, 1, 2)
WINTER_ALT = (11, 1, 2)
AREA_CODES_11 = ("110101", "110102", "110105", "110106", "110107", "110108", "110111",
                 "110112", "110114", "110115", "110120")
AREA_CODES_10 = ("110101", "110102", "110105", "110106", "110107", "110108", "110111",
                 "110112", "110114", "110115")
REFERENCE_BBOX = (116.230633649, 39.863608449, 116.44120325, 39.979627788)
STATION_CATEGORIES = ("公交车站相关", "地铁站")
GRID_ENVELOPE = (115.8528796421, 39.59634, 116.94819, 40.3898263)

# ---- query parameters (chosen once; see FIXTURES.md) -------------------------------
START, END = "2024-01-01", "2024-02-01"           # events span January 2024
YEAR_LO, YEAR_HI = "1996-01-01", "1997-01-01"     # on points_by_month (midnight rows)
R_POI = 1500.0
R_EXPO, R2_EXPO = 400.0, 4500.0
R_ROAD_SMALL, R_ROAD = 50.0, 200.0
TOP = 10
GRID_NX = GRID_NY = 2
FINE_NX, FINE_NY = 12, 9
ZOOM = 14                # the reference's configured plot zoom (min = max = 14)
ZMIN, ZMAX = 14, 16      # heat maps: several zooms in one pass
SECOND_BOUND = "2024-01-16"
SECONDS = ("2024-01-05 06:07:08", "2024-01-20 18:19:20")
SHAPE_BOX = (12940000.0, 4846000.0, 12950000.0, 4852000.0)
CATEGORIES = ("click", "view")
UTM_X0, UTM_Y0, UTM_CELL, UTM_NX, UTM_NY = 431000.0, 4409000.0, 1000.0, 26, 22
HEAT_REGION = (12936000.0, 4842000.0, 12958000.0, 4862000.0)
CONTAIN_ENV = (12935000.0, 4841000.0, 12950000.0, 4860000.0)
# -------------------------------------------------------------------------------------


def _ms(text: str) -> int:
    return TF.to_ms_literal(text)


def _pts(spark, sf):
    return FX.points(spark, sf)


def _pbm(spark, sf):
    return FX.points_by_month(spark, sf)


# ======================================================================================
# Spark side
# ======================================================================================

def q_points(spark, sf):
    p = jobs.with_date(_pts(spark, sf))
    return p.select("event_id", "lng", "lat", "sys_ms", "area_code", "company_code", "num_bikes", "date",
                    F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def q_time_range(spark, sf):
    return P.time_range(_pbm(spark, sf), YEAR_LO, YEAR_HI, ts_col="ts").select("event_id", "sys_ms")


def q_time_range_seconds(spark, sf):
    """Bounds to the second."""
    return P.time_range(_pts(spark, sf), *SECONDS, ts_col="ts").select("event_id", "sys_ms")


def q_hour_is(spark, sf):
    return P.hour_is(_pts(spark, sf), 8).select("event_id", "sys_ms")


def q_season_filter(spark, sf):
    p = P.season_filter(_pbm(spark, sf), WINTER, AREA_CODES_11)
    return p.select("event_id", "area_code", TF.ms_month("sys_ms").alias("month"))


def q_season_filter_alt(spark, sf):
    p = P.season_filter(_pbm(spark, sf), WINTER_ALT, AREA_CODES_10)
    return p.select("event_id", "area_code", TF.ms_month("sys_ms").alias("month"))


def q_within_bbox(spark, sf):
    return P.within_bbox(_pts(spark, sf), REFERENCE_BBOX).select("event_id", "lng", "lat")


def q_category_filter(spark, sf):
    return P.category_filter(_pts(spark, sf), "company_code", CATEGORIES).select("event_id", "company_code")


def q_swap_columns(spark, sf):
    return P.swap_columns(FX.pois(spark, sf, mercator=False), "lng", "lat")


def q_counts_per_second(spark, sf):
    return A.counts_per_second(_pts(spark, sf), upper=SECOND_BOUND)


def q_count_by(spark, sf):
    return A.count_by(_pts(spark, sf), "company_code")


def q_count_by_month(spark, sf):
    return A.count_by_month(_pbm(spark, sf))


def q_count_by_area_company(spark, sf):
    return A.count_by(_pts(spark, sf), "area_code", "company_code")


def q_monthly_sum(spark, sf):
    return A.monthly_sum(jobs.with_date(_pts(spark, sf)), "date", "num_bikes")


def q_monthly_sum_orders(spark, sf):
    o = FX.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").cast("string").alias("date"),
        (F.col("o_totalprice") / F.lit(1000.0)).cast("int").cast("string").alias("num_bikes"))
    return A.monthly_sum(o, "date", "num_bikes")


def q_geohash_hourly_counts(spark, sf):
    p = P.time_range(_pts(spark, sf), START, END, whole_days=True, ts_col="ts")
    return A.geohash_hourly_counts(p, 8)


def q_geohash_hourly_counts_stream(spark, sf):
    from ..streaming import hourly
    return hourly.geohash_hourly_counts_stream(spark, sf, 8, _ms(START), _ms(END))


def q_equal_grid_counts(spark, sf):
    return A.equal_grid_counts(_pts(spark, sf), GRID_ENVELOPE, nx=GRID_NX, ny=GRID_NY)


def q_equal_grid_hourly_counts(spark, sf):
    return A.equal_grid_hourly_counts(_pts(spark, sf), START, END, GRID_ENVELOPE, nx=GRID_NX, ny=GRID_NY)


def q_fine_grid_hourly_counts(spark, sf):
    """A3 on a grid most of whose cells are empty in any hour."""
    return A.equal_grid_hourly_counts(_pts(spark, sf), START, END, GRID_ENVELOPE, nx=FINE_NX, ny=FINE_NY)


def q_extent(spark, sf):
    e = A.extent(_pts(spark, sf))
    return e.select(*[F.round(c, 3).alias(c) for c in ("minx", "miny", "maxx", "maxy")], "count")


def q_poi_circle_counts(spark, sf):
    return jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI)


def q_join_cardinality(spark, sf):
    c = jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI)
    return A.join_cardinality(c, ["poi_lng", "poi_lat"])


def q_join_members(spark, sf):
    pairs = jobs.poi_circle_pairs(_pts(spark, sf), FX.pois(spark, sf), R_POI, distinct=True)
    return A.join_members(pairs, ["poi_lng", "poi_lat"], ["lng", "lat"], unique=True)


def _circle_density(df):
    return df.withColumn("density", F.round(F.col("density") * F.lit(1e6), 9))


def q_density_rank(spark, sf):
    c = jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI)
    return _circle_density(A.density_rank(c, ["poi_lng", "poi_lat"], jobs.circle_area(R_POI)))


def q_top_density(spark, sf):
    c = jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI)
    return _circle_density(A.top_density(c, ["poi_lng", "poi_lat"], jobs.circle_area(R_POI), TOP))


def q_top_count(spark, sf):
    c = jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI)
    return A.top_count(c, ["poi_lng", "poi_lat"], TOP)


def q_road_pairs_dedupe(spark, sf):
    return jobs.road_pairs(_pts(spark, sf), FX.roads(spark, sf), R_ROAD, dedupe=True)


def q_road_pairs(spark, sf):
    return jobs.road_pairs(_pts(spark, sf), FX.roads(spark, sf), R_ROAD_SMALL, dedupe=False)


def q_road_daily_counts(spark, sf):
    return jobs.road_daily_counts(_pts(spark, sf), FX.roads(spark, sf), R_ROAD, START, END, ts_col="ts")


def q_road_daily_counts_unsorted(spark, sf):
    return jobs.road_daily_counts(_pts(spark, sf), FX.roads(spark, sf), R_ROAD, START, END, sort=False, ts_col="ts")


def q_poi_daily_counts(spark, sf):
    return jobs.poi_daily_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI, START, END, by_poi=True, bbox=REFERENCE_BBOX, ts_col="ts")


def q_poi_daily_counts_by_date(spark, sf):
    return jobs.poi_daily_counts(_pts(spark, sf), FX.pois(spark, sf), R_POI, START, END, by_poi=False, bbox=REFERENCE_BBOX, ts_col="ts")


def q_exposure_counts(spark, sf):
    return jobs.exposure_counts(_pts(spark, sf), FX.pois(spark, sf), FX.cases(spark, sf),
                                R_EXPO, R2_EXPO, START, END, bbox=REFERENCE_BBOX, ts_col="ts")


def q_pois_near_cases(spark, sf):
    return jobs.pois_near_cases(FX.pois(spark, sf), FX.cases(spark, sf), R2_EXPO)


def q_pois_far_from_cases(spark, sf):
    """J12 the other way: an anti join on circles."""
    return jobs.pois_near_cases(FX.pois(spark, sf), FX.cases(spark, sf), R2_EXPO, how="left_anti")


def q_points_on_roads(spark, sf):
    """Semi join on line buffers: point records within r of any road."""
    return jobs.points_off_roads(_pts(spark, sf), FX.roads(spark, sf), R_ROAD_SMALL, how="left_semi").select("event_id", "sys_ms")


def q_points_off_roads(spark, sf):
    """Anti join on line buffers."""
    return jobs.points_off_roads(_pts(spark, sf), FX.roads(spark, sf), R_ROAD_SMALL).select("event_id", "sys_ms")


def q_points_in_areas(spark, sf):
    """Semi join on polygons: a point in several areas comes once."""
    return jobs.points_in_areas(_pts(spark, sf), FX.holed_areas(spark, sf)).select("event_id", "sys_ms")


def q_points_outside_areas(spark, sf):
    """Anti join on polygons."""
    return jobs.points_in_areas(_pts(spark, sf), FX.holed_areas(spark, sf), how="left_anti").select("event_id", "sys_ms")


def q_poi_case_distances(spark, sf):
    p = FX.pois(spark, sf).select("objectid", "x", "y")
    c = FX.cases(spark, sf).select("case_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    d = J.distance_join(p, c, R2_EXPO, window_xy=("cx", "cy"))
    return d.select("objectid", "case_id", F.round("distance", 3).alias("distance"))


def q_labeled_area_counts(spark, sf):
    return jobs.labeled_area_counts(_pts(spark, sf), FX.areas(spark, sf), START, END, ts_col="ts")


def q_fishnet_daily_counts(spark, sf):
    return jobs.fishnet_daily_counts(_pts(spark, sf), FX.fishnet(spark), START, END, ts_col="ts")


def q_fishnet_counts(spark, sf):
    return jobs.fishnet_counts(_pts(spark, sf), FX.fishnet(spark), START, END, ts_col="ts")


def _streamed(spark, sf):
    """The points of the batch queries as a stream over the same file, and a run of its own."""
    from ..streaming import hourly
    pts = P.time_range(FX.points_from_events(hourly.table_stream(spark, f"{sf.rstrip('/')}/events.parquet"), keep_ts=True), START, END, ts_col="ts")
    run = uuid.uuid4().hex
    return pts, run, f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream_tables/{run}"


def q_fishnet_daily_counts_stream(spark, sf):
    from ..streaming import fishnet
    pts, run, path = _streamed(spark, sf)
    return fishnet.fishnet_daily_counts(pts, FX.fishnet(spark), run, path)


def q_fishnet_counts_stream(spark, sf):
    from ..streaming import fishnet
    pts, run, path = _streamed(spark, sf)
    return fishnet.fishnet_counts(pts, FX.fishnet(spark), run, path, watermark="40 days")


def q_regular_fishnet_counts(spark, sf):
    return jobs.regular_fishnet_counts(_pts(spark, sf), FX.FISHNET_X0, FX.FISHNET_Y0, FX.FISHNET_CELL,
                                       FX.FISHNET_NX, FX.FISHNET_NY, START, END, ts_col="ts")


def q_to_utm(spark, sf):
    p = _pts(spark, sf)
    e, n = crs.to_utm("lng", "lat", 50)
    return p.select("event_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def q_gcj_delta(spark, sf):
    d = crs.gcj_delta("lng", "lat")
    return _pts(spark, sf).select("event_id", F.round(d["dlng"], 9).alias("dlng"), F.round(d["dlat"], 9).alias("dlat"))


def q_gcj_to_wgs(spark, sf):
    w = crs.gcj_to_wgs_arrow("lng", "lat")
    return _pts(spark, sf).select("event_id", F.round(w["lng"], 8).alias("wgs_lng"), F.round(w["lat"], 8).alias("wgs_lat"))


def q_gcj_to_wgs_fold(spark, sf):
    w = crs.gcj_to_wgs("lng", "lat")
    return _pts(spark, sf).select("event_id", F.round(w["lng"], 8).alias("wgs_lng"), F.round(w["lat"], 8).alias("wgs_lat"))


def q_project_points(spark, sf):
    p = FX.pois(spark, sf)
    return p.select("objectid", "name", "lng", "lat", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def q_geohash_encode(spark, sf):
    return geohash.with_geohash(_pts(spark, sf), "lng", "lat", 8, "geohash").select("event_id", "geohash")


def q_geohash_bounds(spark, sf):
    d = geohash.with_geohash_bounds(geohash.with_geohash(_pts(spark, sf), precision=6, name="gh"), "gh")
    return d.select("event_id", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"),
                    F.round("lng_err", 12).alias("lng_err"), F.round("lat_err", 12).alias("lat_err"))


def q_point_rectangles(spark, sf):
    d = geohash.with_point_rectangle(_pts(spark, sf).select("event_id", "lng", "lat"), precision=8, prefix="r_")
    return d.select("event_id", *[F.round("r_" + c, 9).alias(c) for c in ("max_lng", "max_lat", "min_lng", "min_lat")])


def q_geom_from_wkt(spark, sf):
    g = jobs.with_geom(FX.roads(spark, sf))
    b = G.bbox(F.col("geom"))
    return g.select("id", F.col("geom.kind").alias("kind"), F.size(G.vertices(F.col("geom"))).alias("n_vertices"),
                    b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


def q_geom_to_wkt(spark, sf):
    g = jobs.with_geom(FX.areas(spark, sf))
    return g.select("id", G.geom_to_wkt(F.col("geom")).alias("wkt"))


def q_area(spark, sf):
    g = jobs.with_geom(FX.areas(spark, sf))
    return g.select("id", F.round(G.area(F.col("geom")), 3).alias("area"))


def q_line_buffer(spark, sf):
    g = jobs.with_geom(C.dealt(FX.roads(spark, sf)))
    sizes = G.let(G.line_buffer(F.col("geom"), R_ROAD_SMALL), lambda buf: F.struct(F.size(buf["parts"]).alias("n_parts"), F.size(G.vertices(buf)).alias("n_vertices")))
    return g.select("id", sizes.alias("sizes")).select("id", "sizes.n_parts", "sizes.n_vertices")


def q_envelope_contains(spark, sf):
    g = jobs.with_geom(FX.roads(spark, sf))
    return g.filter(G.envelope_contains(F.col("geom"), *CONTAIN_ENV)).select("id")


def q_tile_of_lonlat(spark, sf):
    t = tiles.tile_of_lonlat("lng", "lat", ZOOM)
    return _pts(spark, sf).select("event_id", t["z"].alias("z"), t["x"].alias("tx"), t["y"].alias("ty"))


def q_tile_of_mercator(spark, sf):
    t = tiles.tile_of_mercator("x", "y", ZOOM)
    return _pts(spark, sf).select("event_id", t["z"].alias("z"), t["x"].alias("tx"), t["y"].alias("ty"))


def _point_tiles(spark, sf):
    t = tiles.tile_of_mercator("x", "y", ZOOM)
    return _pts(spark, sf).select(t["x"].alias("tx"), t["y"].alias("ty")).distinct()


def q_tile_to_lonlat(spark, sf):
    c = tiles.tile_to_lonlat("tx", "ty", ZOOM)
    return _point_tiles(spark, sf).select("tx", "ty", F.round(c["lng"], 9).alias("lng"), F.round(c["lat"], 9).alias("lat"))


def q_tile_to_mercator(spark, sf):
    c = tiles.tile_to_mercator("tx", "ty", ZOOM)
    return _point_tiles(spark, sf).select("tx", "ty", F.round(c["x"], 3).alias("mx"), F.round(c["y"], 3).alias("my"))


def q_tile_path(spark, sf):
    return _point_tiles(spark, sf).select("tx", "ty", tiles.tile_path("tx", "ty", ZOOM).alias("path"))


def q_tile_bounds(spark, sf):
    b = R.tile_bounds(A.extent(_pts(spark, sf)), 0, ZMAX)
    return b.select("z", *[F.round(c, 3).alias(c) for c in ("west", "north", "east", "south")])


def q_tile_offsets(spark, sf):
    return R.tile_offsets(A.extent(_pts(spark, sf)), ZMAX)


def q_heat_pixels(spark, sf):
    return R.heat_pixels(_pts(spark, sf), ZMIN, ZMAX)


def q_blur_pixels(spark, sf):
    b = R.blur_pixels(R.heat_pixels(_pts(spark, sf), ZMIN, ZMAX))
    return b.select("z", "tx", "ty", "px", "py", F.round("value", 9).alias("value"))


def q_line_pixels(spark, sf):
    g = jobs.with_geom(C.dealt(FX.roads(spark, sf)))
    return R.line_pixels(g, ZMIN, ZMAX, geom_col="geom")


def q_tile_summary(spark, sf):
    return R.tile_summary(R.heat_pixels(_pts(spark, sf), ZMIN, ZMAX))


# ---- windows that share places and ids, and reports on line and polygon windows ------

def _shared_roads(spark, sf):
    """Every road with its ID and place taken modulo 100 and 150: IDs and geometries repeat."""
    return FX.roads(spark, sf, ident=F.col("p_partkey") % F.lit(150)).withColumn("id", F.col("id") % F.lit(100))


def q_poi_circle_counts_shared(spark, sf):
    """J1 on POIs of which many stand at one place."""
    return jobs.poi_circle_counts(_pts(spark, sf), FX.pois(spark, sf, ident=F.col("s_suppkey") % F.lit(7)), R_POI)


def q_road_pairs_shared(spark, sf):
    return jobs.road_pairs(_pts(spark, sf), _shared_roads(spark, sf), R_ROAD_SMALL, dedupe=False)


def q_road_pairs_dedupe_shared(spark, sf):
    return jobs.road_pairs(_pts(spark, sf), _shared_roads(spark, sf), R_ROAD_SMALL, dedupe=True)


def q_road_daily_counts_shared(spark, sf):
    return jobs.road_daily_counts(_pts(spark, sf), _shared_roads(spark, sf), R_ROAD_SMALL, START, END, ts_col="ts")


def _ranked(df, n=None):
    """Row number of an ordered report, so that its order is compared too."""
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("density").desc(), "id", "wkt")).cast("long"))


def _road_windows(spark, sf):
    c = jobs.road_window_counts(_pts(spark, sf), _shared_roads(spark, sf), R_ROAD)
    return c.withColumn("area", F.round("area", 3))


def q_line_density_rank(spark, sf):
    d = A.density_rank(_road_windows(spark, sf), ["id", "wkt"], F.col("area"))
    return d.withColumn("density", F.round(F.col("density") * F.lit(1e6), 6))


def q_line_top_density(spark, sf):
    d = A.top_density(_road_windows(spark, sf), ["id", "wkt"], F.col("area"), TOP)
    return _ranked(d).withColumn("density", F.round(F.col("density") * F.lit(1e6), 6))


def q_line_top_count(spark, sf):
    return A.top_count(_road_windows(spark, sf).select("id", "wkt", "n"), ["id", "wkt"], TOP)


def q_line_cardinality(spark, sf):
    return A.join_cardinality(_road_windows(spark, sf), ["id", "wkt"])


def q_line_members(spark, sf):
    return jobs.road_members(_pts(spark, sf), _shared_roads(spark, sf), R_ROAD_SMALL)


def _area_windows(spark, sf):
    return jobs.area_window_counts(_pts(spark, sf), FX.holed_areas(spark, sf))


def q_polygon_density_rank(spark, sf):
    d = A.density_rank(_area_windows(spark, sf), ["id", "wkt"], F.col("area"))
    return d.withColumn("density", F.round(F.col("density") * F.lit(1e6), 6))


def q_polygon_top_density(spark, sf):
    d = A.top_density(_area_windows(spark, sf), ["id", "wkt"], F.col("area"), TOP)
    return _ranked(d).withColumn("density", F.round(F.col("density") * F.lit(1e6), 6))


def q_polygon_top_count(spark, sf):
    return A.top_count(_area_windows(spark, sf).select("id", "wkt", "n"), ["id", "wkt"], TOP)


def q_polygon_cardinality(spark, sf):
    return A.join_cardinality(_area_windows(spark, sf), ["id", "wkt"])


def q_polygon_members(spark, sf):
    pairs = jobs.area_members(_pts(spark, sf), FX.holed_areas(spark, sf))
    return A.join_members(pairs, ["id"], ["lng", "lat"], unique=True)


def _cover(near, covered):
    """Per road id how many points are inner and covered, inner and missed, or covered without being near. The two sets
    of (id, event_id) pairs meet in one sum by that pair, as a join of both would have them: rows that repeat multiply,
    and a null meets nothing."""
    one, none = F.lit(1), F.lit(0)
    flags = near.select("id", "event_id", F.when(F.col("inner"), one).otherwise(none).alias("inner"), one.alias("near"), none.alias("covered"))
    both = flags.unionByName(covered.select("id", "event_id", none.alias("inner"), none.alias("near"), one.alias("covered")))
    both = both.groupBy("id", "event_id").agg(F.sum("inner").alias("i"), F.sum("near").alias("n"), F.sum("covered").alias("c"))
    lone = F.col("id").isNull() | F.col("event_id").isNull()
    of = lambda c, value: F.coalesce(F.sum(F.when(c, value).otherwise(0)), F.lit(0)).cast("long")
    return both.groupBy("id").agg(of(~lone, F.col("i") * F.col("c")).alias("n_inner"), of(lone | (F.col("c") == 0), F.col("i")).alias("n_missed"),
                                  of(lone | (F.col("n") == 0), F.col("c")).alias("n_outside")).filter("n_inner + n_missed + n_outside > 0")


def q_line_buffer_cover(spark, sf):
    """G2's shape: per road, points safely within r that lie in a capsule of its buffer
    (n_inner), that lie in none (n_missed), and points of a capsule beyond r (n_outside).
    Arcs are inscribed, so the capsule reaches r · cos(pi / 32) at least and r at most."""
    pts, roads = C.dealt(_pts(spark, sf)).select("event_id", "x", "y"), jobs.with_geom(C.dealt(FX.roads(spark, sf))).select("id", "geom")
    part = F.explode(G.line_buffer(F.col("geom"), R_ROAD_SMALL)["parts"])
    capsules = roads.select("id", part.alias("p")).select("id", F.struct(F.lit("POLYGON").alias("kind"), F.array("p").alias("parts")).alias("geom"))
    covered = J.polygon_join(pts, capsules, boundary=True, blocks=["id", "event_id"]).select("id", "event_id").distinct()
    near = J.line_buffer_join(pts, roads, R_ROAD_SMALL, blocks=["id", "event_id", "distance"]).select("id", "event_id", (F.col("distance") < R_ROAD_SMALL * math.cos(math.pi / 32)).alias("inner"))
    return _cover(near, covered)


def q_dissolved_buffer_cover(spark, sf):
    """The same of each road's one dissolved outline."""
    layer = jobs.road_layer(FX.roads(spark, sf))
    outlines = buffers.dissolved_buffers(layer, R_ROAD_SMALL).join(layer.select("_wid", "id"), "_wid").select("id", F.col("buffer").alias("geom"))
    pts = C.dealt(_pts(spark, sf)).select("event_id", "x", "y")
    covered = J.polygon_join(pts, outlines, boundary=True, blocks=["id", "event_id"]).select("id", "event_id")
    near = J.line_buffer_join(pts, FX.roads(spark, sf), R_ROAD_SMALL, layer=layer, blocks=["id", "event_id", "distance"]).select("id", "event_id", (F.col("distance") < R_ROAD_SMALL * math.cos(math.pi / (4 * buffers.STEPS))).alias("inner"))
    return _cover(near, covered)


def q_area_holed(spark, sf):
    g = jobs.with_geom(FX.holed_areas(spark, sf))
    return g.select("id", F.round(G.area(F.col("geom")), 3).alias("area"))


# ---- UTM fishnets and the datum-shifted, clipped heat map --------------------------------

def _utm_net(spark):
    return FX.fishnet(spark, UTM_X0, UTM_Y0, UTM_CELL, UTM_NX, UTM_NY)


def q_utm_fishnet_daily_counts(spark, sf):
    return jobs.fishnet_daily_counts(jobs.to_utm_points(_pts(spark, sf), 50), _utm_net(spark), START, END, ts_col="ts")


def q_utm_fishnet_counts(spark, sf):
    return jobs.fishnet_counts(jobs.to_utm_points(_pts(spark, sf), 50), _utm_net(spark), START, END, ts_col="ts")


def q_shifted_heat_pixels(spark, sf):
    raw = FX.points(spark, sf, mercator=False).select("lng", "lat")
    w = crs.gcj_to_wgs_arrow("lng", "lat")
    shifted = raw.select(w.alias("w")).select(F.col("w.lng").alias("lng"), F.col("w.lat").alias("lat"))
    return R.heat_pixels(FX.with_mercator(shifted), ZMIN, ZMAX, region=HEAT_REGION)


# ---- sources and sinks: written under the shared checkpoint folder and read back ---------

def _path(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{uuid.uuid4().hex}"


def _raw_points(spark, sf):
    """Point records as a source file has them; every seventh latitude is not a number."""
    p = FX.points(spark, sf, mercator=False)
    bad = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("lat").cast("string"))
    return p.select("event_id", F.col("lng").cast("string").alias("lng"), bad.alias("lat"), F.col("sys_ms").alias("sysTime"), "company_code")


def _rounded(df):
    return df.select("event_id", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"), *[c for c in ("sys_ms", "company_code") if c in df.columns])


def q_csv_points(spark, sf):
    """S1, C1, K1."""
    path = _path(spark)
    sinks.write_table(_raw_points(spark, sf), path)
    p = readers.read_points(spark, path, keep=["event_id", "company_code"], mercator=False)
    return _rounded(p.withColumn("event_id", F.col("event_id").cast("long")))


def q_csv_points_by_position(spark, sf):
    """No header, columns by place, no time."""
    path = _path(spark)
    sinks.write_table(_raw_points(spark, sf), path, header=False)
    p = readers.read_points(spark, path, header=False, lng=1, lat=2, time=None, keep=["_c0"], mercator=False)
    return _rounded(p.withColumn("event_id", F.col("_c0").cast("long")))


def q_csv_points_inferred(spark, sf):
    """S4."""
    path = _path(spark)
    sinks.write_table(_raw_points(spark, sf).drop("lat"), path)
    d = readers.read_csv(spark, path, infer=True)
    return d.select(F.col("event_id").cast("long").alias("event_id"), F.round("lng", 9).alias("lng"), F.col("sysTime").cast("long").alias("sys_ms"))


def _checked_points(spark, sf):
    """Point records of which some have a bad latitude, no longitude, a field too many or one too few."""
    path = _path(spark)
    r, i = _raw_points(spark, sf), F.col("event_id")
    text = F.concat_ws(",", i, F.when(i % 17 != 0, F.col("lng")).otherwise(F.lit("")), "lat", "sysTime", F.when(i % 13 != 0, F.col("company_code")))
    sinks.write_table(r.select(F.when(i % 11 == 0, F.concat(text, F.lit(",more"))).otherwise(text).alias("line")), path, fmt="text")
    return readers.read_checked(spark, path, "event_id long, lng double, lat double, sys_ms long, company_code string", header=False)


def q_csv_points_checked(spark, sf):
    """S1, S2 with a declared schema: bad records beside good ones."""
    return _checked_points(spark, sf).select("event_id", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"), "sys_ms", "company_code", F.col(readers.BAD).isNotNull().alias("is_bad"))


def q_csv_points_accounted(spark, sf):
    """How many records are good, bad, and without a longitude."""
    return readers.accounted(_checked_points(spark, sf), required=["lng", "company_code"])


def q_shifted_untimed_points(spark, sf):
    """S2 with the datum shift and the projection; a bad latitude gives nulls."""
    path = _path(spark)
    sinks.write_table(_raw_points(spark, sf), path, sep="\t")
    p = readers.read_points(spark, path, sep="\t", time=None, keep=["event_id"], gcj_to_wgs=True)
    return p.select(F.col("event_id").cast("long").alias("event_id"), F.round("lng", 8).alias("lng"), F.round("lat", 8).alias("lat"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def q_winter_points_headerless(spark, sf):
    """P5: a headerless file by position, winter months, any area."""
    path = _path(spark)
    p = _pbm(spark, sf)
    sinks.write_table(p.select("event_id", "area_code", "lng", "lat", "sys_ms"), path, header=False)
    read = readers.read_points(spark, path, header=False, lng=2, lat=3, time=4, keep=["_c0"], mercator=False)
    return P.season_filter(read, WINTER, None).select(F.col("_c0").cast("long").alias("event_id"), TF.ms_month("sys_ms").alias("month"))


def q_shapefile_areas(spark, sf):
    """Areas with holes written as shapefiles (shells clockwise) and read back."""
    path = _path(spark)
    shapes.write_shapes(jobs.with_geom(FX.holed_areas(spark, sf)).select("id", "geom"), path)
    r = shapes.read_shapes(spark, path)
    return r.select(F.col("id").cast("long").alias("id"), F.col("geometry").alias("wkt"), "minx", "maxy")


def q_shapefile_roads_in_box(spark, sf):
    """Roads whose box meets another, by predicates that the source answers itself."""
    path = _path(spark)
    shapes.write_shapes(jobs.with_geom(FX.roads(spark, sf)).select("id", "geom"), path)
    x0, y0, x1, y1 = SHAPE_BOX
    meets = (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)
    return shapes.read_shapes(spark, path).filter(meets).select(F.col("id").cast("long").alias("id"), F.col("geom.kind").alias("kind"), F.size(G.vertices(F.col("geom"))).alias("n_vertices"))


def q_wkt_table(spark, sf):
    """Delimited text with WKT, every tenth geometry with a bad vertex."""
    path = _path(spark)
    r = FX.roads(spark, sf)
    sinks.write_table(r.select("id", F.when(F.col("id") % 10 == 0, F.lit("LINESTRING (1, 2 3)")).otherwise(F.col("wkt")).alias("geom")), path, sep="|")
    g = readers.read_wkt_table(spark, path)
    return g.select(F.col("id").cast("long").alias("id"), F.col("geometry.kind").alias("kind"), F.size(G.vertices(F.col("geometry"))).alias("n_vertices"))


def q_text_lines(spark, sf):
    """K6 with nulls, S6, D10: lines joined and split again, all fields kept."""
    path = _path(spark)
    d = _raw_points(spark, sf).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("company_code")).alias("company_code"), F.col("event_id").alias("again"))
    sinks.write_table(d, path, fmt="text", sep=";")
    f = F.col("fields")
    return readers.read_lines(spark, path, sep=";", skip_header=False).select(F.get(f, 0).cast("long").alias("event_id"), F.get(f, 1).alias("company_code"), F.get(f, 2).cast("long").alias("again"), F.size(f).alias("n_fields"))


def q_sorted_text(spark, sf):
    """Lines sorted by their text; the place of each among all."""
    path = _path(spark)
    sinks.write_table(FX.pois(spark, sf, mercator=False).select("name", "objectid"), path, fmt="text", sort_by="name")
    at = F.col("_metadata.file_block_start")  # a large file is read in blocks
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("i"))
    return ranking.numbered_rows(lines, "file", "block", "i").select("value", "place")


def q_numbered_points(spark, sf):
    """Every point record numbered by time, then event_id."""
    return ranking.numbered_rows(_pts(spark, sf).select("event_id", "sys_ms"), "sys_ms", F.col("event_id").desc()).select("event_id", "place")


def _folders(df, column):
    return df.groupBy(F.col(column).cast("string").alias(column)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))


def q_month_folders(spark, sf):
    """K2."""
    path = _path(spark)
    sinks.write_table(sinks.regroup_by(_pbm(spark, sf).select("event_id", "sys_ms"), "month"), path, partition_by="month")
    return _folders(spark.read.option("header", True).csv(path), "month")


def q_date_folders(spark, sf):
    """K3, as JSON (K4)."""
    path = _path(spark)
    sinks.write_table(sinks.regroup_by(_pts(spark, sf).select("event_id", "sys_ms"), "date"), path, fmt="json", partition_by=["date"])
    return _folders(spark.read.json(path), "date")


def q_hour_folders(spark, sf):
    """K3 per hour, tab-separated (K5)."""
    path = _path(spark)
    hours = sinks.regroup_by(_pts(spark, sf).select("event_id", "sys_ms"), "date_hour")
    sinks.write_table(hours, path, sep="\t", partition_by="date_hour")
    return _folders(spark.read.option("header", True).option("sep", "\t").csv(path), "date_hour")


def q_year_folders(spark, sf):
    """K7."""
    path = _path(spark)
    sinks.split_by_year(_pbm(spark, sf).select("event_id", "sys_ms"), path)
    return _folders(spark.read.option("header", True).csv(path), "year")


# ---- SQL text: the same joins with the registered geometry functions ---------------------

def _sql_views(spark, sf):
    sqlfuncs.register_all(spark)
    pts = jobs.with_date(P.time_range(_pts(spark, sf), START, END, ts_col="ts"))
    for name, df in (("v_points", pts), ("v_roads", FX.roads(spark, sf)), ("v_pois", FX.pois(spark, sf)), ("v_areas", FX.holed_areas(spark, sf))):
        (df if name == "v_points" else C.dealt(df)).createOrReplaceTempView(name)


def _sql_join(spark, window: str, select: str, where: str, reach: float, size: float, keys: str) -> str:
    """A cell join in SQL: windows (id, g) by the cells of their reach and with its box, points (p) by their cell.
    Both meet in as many tasks as a shuffle has: they are few bytes, but much work. The box's test is in
    a coalesce, of which Spark infers no IS NOT NULL: that would parse every window in the scan's one task."""
    dealt, wide = f"/*+ REPARTITION({int(spark.conf.get('spark.sql.shuffle.partitions'))}, cx, cy) */", f"({reach}D + 1e-6D)"  # wider than any rounding
    box = ", ".join(f"ST_{a}{m}(g) {sign} {wide} AS {a}{m}" for a in "xy" for m, sign in (("min", "-"), ("max", "+")))
    return f"""WITH w AS (SELECT *, {box} FROM ({window})), wc AS (SELECT {dealt} w.*, c.cx, c.cy FROM w, LATERAL cells_of(w.g, {reach}D, {size}D) c),
      pc AS (SELECT {dealt} *, ST_Point(x, y) AS p, CAST(floor(x / {size}D) AS BIGINT) AS cx, CAST(floor(y / {size}D) AS BIGINT) AS cy FROM v_points)
      SELECT /*+ SHUFFLE_HASH(wc) */ {select} FROM pc JOIN wc ON pc.cx = wc.cx AND pc.cy = wc.cy
      WHERE coalesce(x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax, false) AND {where} GROUP BY {keys}"""


def q_sql_road_daily_counts(spark, sf):
    """J4 in SQL: ST_Within(point, ST_Buffer(line, r))."""
    _sql_views(spark, sf)
    return spark.sql(_sql_join(spark, "SELECT id, ST_GeomFromWKT(wkt) AS g FROM v_roads", "id, date, count(*) AS count",
                               f"ST_Within(p, ST_Buffer(g, {R_ROAD}D))", R_ROAD, 1000.0, "id, date"))


def q_sql_poi_daily_counts(spark, sf):
    """J6 in SQL: ST_Distance of transformed points, in the box by ST_Contains."""
    _sql_views(spark, sf)
    minx, miny, maxx, maxy = REFERENCE_BBOX
    inside = f"ST_Contains(ST_PolygonFromEnvelope({minx}D, {miny}D, {maxx}D, {maxy}D), ST_Point(lng, lat))"
    return spark.sql(_sql_join(spark, "SELECT objectid, ST_Transform(ST_Point(lng, lat), 'epsg:4326', 'epsg:3857') AS g FROM v_pois", "objectid, date, count(*) AS join_count",
                               f"{inside} AND ST_Distance(p, g) <= {R_POI}", R_POI, R_POI, "objectid, date"))


def q_sql_area_daily_counts(spark, sf):
    """J9's predicate in SQL: ST_Within(point, polygon with a hole), with its ST_Area."""
    _sql_views(spark, sf)
    return spark.sql(_sql_join(spark, "SELECT id, g, ST_Area(g) AS own FROM (SELECT id, ST_GeomFromText(wkt) AS g FROM v_areas)", "id, date, count(*) AS join_count, max(own) AS area",
                               "ST_Within(p, g)", 0.0, 1000.0, "id, date"))


def q_sql_utm_points(spark, sf):
    """ST_Transform to UTM zone 50 in SQL."""
    _sql_views(spark, sf)
    return spark.sql("""SELECT event_id, round(g.parts[0][0][0].x, 3) AS easting, round(g.parts[0][0][0].y, 3) AS northing
      FROM (SELECT event_id, ST_Transform(ST_Point(lng, lat), 'epsg:4326', 'epsg:32650') AS g FROM v_points)""")


def q_sql_shifted_points(spark, sf):
    """The datum shift in SQL, both coordinates from one run of the iteration."""
    _sql_views(spark, sf)
    return spark.sql("SELECT event_id, round(trans_lon(lng, lat), 8) AS wgs_lng, round(trans_lat(lng, lat), 8) AS wgs_lat FROM v_points")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}


# ======================================================================================
# DuckDB oracle (brute force)
# ======================================================================================

def _pts_cte(src: str = "events") -> str:
    if src == "events":
        u, e, ts, extra = "user_id", "event_id", "ts", (
            ", event_type AS company_code, CAST(trunc(value) AS INTEGER) AS num_bikes")
    else:
        u, e, ts, extra = "o_custkey", "o_orderkey", "o_orderdate", ", o_orderstatus AS company_code"
    return f"""pts0 AS (
  SELECT {e} AS event_id, {ts} AS ts,
    116.2 + CAST(({u}*7919 + {e}*104729) % 1000003 AS DOUBLE) / 1000003.0 * 0.28 AS lng,
    39.83 + CAST(({u}*15485863 + {e}*1299709) % 1000033 AS DOUBLE) / 1000033.0 * 0.18 AS lat,
    epoch_us({ts}) // 1000 AS sys_ms,
    CAST(110101 + {u} % 20 AS VARCHAR) AS area_code{extra}
  FROM {src}),
pts AS (
  SELECT *, lng * 20037508.342789244 / 180.0 AS x,
    ln(tan((90.0 + lat) * pi() / 360.0)) * 6378137.0 AS y,
    strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hr,
    CAST(month(ts) AS INTEGER) AS mon
  FROM pts0)"""


PTS = _pts_cte("events")
PBM = _pts_cte("orders")

POIS = """pois AS (
  SELECT s_suppkey AS objectid, s_name AS name,
    116.2 + CAST((s_suppkey*7919) % 10007 AS DOUBLE) / 10007.0 * 0.28 AS lng,
    39.83 + CAST((s_suppkey*104729) % 10009 AS DOUBLE) / 10009.0 * 0.18 AS lat
  FROM supplier),
poism AS (SELECT *, lng * 20037508.342789244 / 180.0 AS x,
    ln(tan((90.0 + lat) * pi() / 360.0)) * 6378137.0 AS y FROM pois)"""

CASES = """cases AS (
  SELECT CAST(n_nationkey AS BIGINT) AS case_id,
    CAST(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS DATE) AS cdate,
    116.2 + CAST((n_nationkey*6101) % 997 AS DOUBLE) / 997.0 * 0.28 AS lng,
    39.83 + CAST((n_nationkey*3571) % 991 AS DOUBLE) / 991.0 * 0.18 AS lat
  FROM nation),
casesm AS (SELECT *, lng * 20037508.342789244 / 180.0 AS x,
    ln(tan((90.0 + lat) * pi() / 360.0)) * 6378137.0 AS y,
    epoch_ms(CAST(cdate AS TIMESTAMP)) AS day_ms FROM cases)"""

ROAD_SEGS = """road_segs AS (
  SELECT p_partkey AS id, k,
    CAST(12935000 + (p_partkey*7919) % 31000 + k*400 AS DOUBLE) AS x1,
    CAST(4841000 + (p_partkey*104729) % 26000 + (p_partkey*k*37) % 500 AS DOUBLE) AS y1,
    CAST(12935000 + (p_partkey*7919) % 31000 + (k+1)*400 AS DOUBLE) AS x2,
    CAST(4841000 + (p_partkey*104729) % 26000 + (p_partkey*(k+1)*37) % 500 AS DOUBLE) AS y2
  FROM part, range(4) t(k))"""

SEG_DIST = """sqrt(
  (p.x - (s.x1 + (CASE WHEN (s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1) = 0 THEN 0.0 ELSE
      greatest(0.0, least(1.0, ((p.x - s.x1)*(s.x2-s.x1) + (p.y - s.y1)*(s.y2-s.y1)) / ((s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1)))) END) * (s.x2-s.x1)))
  * (p.x - (s.x1 + (CASE WHEN (s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1) = 0 THEN 0.0 ELSE
      greatest(0.0, least(1.0, ((p.x - s.x1)*(s.x2-s.x1) + (p.y - s.y1)*(s.y2-s.y1)) / ((s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1)))) END) * (s.x2-s.x1)))
  + (p.y - (s.y1 + (CASE WHEN (s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1) = 0 THEN 0.0 ELSE
      greatest(0.0, least(1.0, ((p.x - s.x1)*(s.x2-s.x1) + (p.y - s.y1)*(s.y2-s.y1)) / ((s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1)))) END) * (s.y2-s.y1)))
  * (p.y - (s.y1 + (CASE WHEN (s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1) = 0 THEN 0.0 ELSE
      greatest(0.0, least(1.0, ((p.x - s.x1)*(s.x2-s.x1) + (p.y - s.y1)*(s.y2-s.y1)) / ((s.x2-s.x1)*(s.x2-s.x1) + (s.y2-s.y1)*(s.y2-s.y1)))) END) * (s.y2-s.y1))))"""

AREAS = """areas AS (
  SELECT p_partkey AS id,
    CAST(12935000 + (p_partkey*6113) % 31000 AS DOUBLE) AS cx,
    CAST(4841000 + (p_partkey*9973) % 26000 AS DOUBLE) AS cy
  FROM part)"""

FISHNET = """fishnet AS (
  SELECT range AS oid, 12935000.0 + CAST(range % 32 AS DOUBLE) * 1000.0 AS minx,
    4841000.0 + CAST(range // 32 AS DOUBLE) * 1000.0 AS miny FROM range(864))"""

DIST = "sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y))"


def _range(lo, hi, col="sys_ms"):
    return f"{col} > {_ms(lo)} AND {col} < {_ms(hi)}"


def _bbox(col_x="lng", col_y="lat"):
    minx, miny, maxx, maxy = REFERENCE_BBOX
    return f"{col_x} > {minx} AND {col_x} < {maxx} AND {col_y} > {miny} AND {col_y} < {maxy}"


def _geohash_sql(lng: str, lat: str, precision: int) -> str:
    total = 5 * precision
    n_lng, n_lat = (total + 1) // 2, total // 2

    def q(v, lo, span, n):
        return (f"CAST(least(greatest(ceil(({v} - ({lo})) / {span} * {float(1 << n)}) - 1, 0), {(1 << n) - 1}) AS BIGINT)")
    qx, qy = q(lng, -180.0, 360.0, n_lng), q(lat, -90.0, 180.0, n_lat)
    chars = []
    for i in range(precision):
        terms = []
        for b in range(5):
            j = 5 * i + b
            src, k, n = (qx, j // 2, n_lng) if j % 2 == 0 else (qy, j // 2, n_lat)
            terms.append(f"((({src} >> {n - 1 - k}) & 1) << {4 - b})")
        chars.append(f"substr('{geohash.BASE32}', CAST({' + '.join(terms)} AS INTEGER) + 1, 1)")
    return " || ".join(chars)


_UTM_A = crs.WGS84_A
_UTM_E2 = crs.WGS84_F * (2 - crs.WGS84_F)
_UTM_EP2 = _UTM_E2 / (1 - _UTM_E2)


def _utm_sql(rounded: bool = True) -> str:
    """Easting and northing per event: a final SELECT, or unrounded as the table ``utm``."""
    e2, ep2 = _UTM_E2, _UTM_EP2
    e4, e6 = e2 * e2, e2 ** 3
    lon0 = math.radians(50 * 6 - 183)
    text = f"""utm0 AS (
  SELECT event_id, radians(lat) AS phi, radians(lng) AS lam FROM pts),
utm1 AS (
  SELECT event_id, phi, lam,
    {_UTM_A} / sqrt(1.0 - {e2} * sin(phi) * sin(phi)) AS n,
    tan(phi) * tan(phi) AS t, {ep2} * cos(phi) * cos(phi) AS c,
    cos(phi) * (lam - {lon0}) AS aa,
    {_UTM_A} * ({1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256} * phi - {3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024} * sin(2.0 * phi)
      + {15 * e4 / 256 + 45 * e6 / 1024} * sin(4.0 * phi) - {35 * e6 / 3072} * sin(6.0 * phi)) AS m
  FROM utm0)
SELECT event_id,
  round(500000.0 + 0.9996 * n * (aa + (1.0 - t + c) * aa*aa*aa / 6.0
     + (5.0 - 18.0 * t + t * t + 72.0 * c - {58.0 * ep2}) * aa*aa*aa*aa*aa / 120.0), 3) AS easting,
  round(0.9996 * (m + n * tan(phi) * (aa*aa / 2.0 + (5.0 - t + 9.0 * c + 4.0 * c * c) * aa*aa*aa*aa / 24.0
     + (61.0 - 58.0 * t + t * t + 600.0 * c - {330.0 * ep2}) * aa*aa*aa*aa*aa*aa / 720.0)), 3) AS northing
FROM utm1"""
    if rounded:
        return text
    head, _, tail = text.partition("SELECT event_id,\n  round(")
    return (head.rstrip() + ", utm AS (SELECT event_id, (" + tail.replace(", 3) AS easting,\n  round(", ") AS easting, (")
            .replace(", 3) AS northing", ") AS northing") + ")")


def _gcj_delta_sql(lng: str, lat: str) -> tuple[str, str]:
    x, y = f"({lng} - 105.0)", f"({lat} - 35.0)"
    tl = (f"(-100.0 + 2.0 * {x} + 3.0 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x}))"
          f" + (20.0 * sin(6.0 * {x} * pi()) + 20.0 * sin(2.0 * {x} * pi())) * 2.0 / 3.0"
          f" + (20.0 * sin({y} * pi()) + 40.0 * sin({y} / 3.0 * pi())) * 2.0 / 3.0"
          f" + (160.0 * sin({y} / 12.0 * pi()) + 320.0 * sin({y} * pi() / 30.0)) * 2.0 / 3.0)")
    tn = (f"(300.0 + {x} + 2.0 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x}))"
          f" + (20.0 * sin(6.0 * {x} * pi()) + 20.0 * sin(2.0 * {x} * pi())) * 2.0 / 3.0"
          f" + (20.0 * sin({x} * pi()) + 40.0 * sin({x} / 3.0 * pi())) * 2.0 / 3.0"
          f" + (150.0 * sin({x} / 12.0 * pi()) + 300.0 * sin({x} / 30.0 * pi())) * 2.0 / 3.0)")
    rad = f"({lat} / 180.0 * pi())"
    magic = f"(1.0 - {crs.GCJ_EE} * sin({rad}) * sin({rad}))"
    dlat = f"(({tl} * 180.0) / (({crs.GCJ_AXIS * (1 - crs.GCJ_EE)}) / ({magic} * sqrt({magic})) * pi()))"
    dlng = f"(({tn} * 180.0) / ({crs.GCJ_AXIS} / sqrt({magic}) * cos({rad}) * pi()))"
    return dlng, dlat


def _gcj_iter_sql() -> str:
    ctes = ["g0 AS (SELECT event_id, lng AS glng, lat AS glat, lng AS wlng, lat AS wlat, false AS done FROM pts)"]
    for i in range(crs.GCJ_MAX_STEPS):
        dlng, dlat = _gcj_delta_sql("wlng", "wlat")
        if i == 0:
            conv = f"abs(wlng) <= {crs.GCJ_TOLERANCE} AND abs(wlat) <= {crs.GCJ_TOLERANCE}"
        else:
            conv = f"abs(glng - {dlng} - wlng) <= {crs.GCJ_TOLERANCE} AND abs(glat - {dlat} - wlat) <= {crs.GCJ_TOLERANCE}"
        ctes.append(f"""g{i + 1} AS (SELECT event_id, glng, glat,
    CASE WHEN done THEN wlng ELSE glng - {dlng} END AS wlng,
    CASE WHEN done THEN wlat ELSE glat - {dlat} END AS wlat,
    CASE WHEN done THEN true ELSE ({conv}) END AS done FROM g{i})""")
    return ",\n".join(ctes)


def _pixel_sql(z: str, x: str, y: str) -> tuple[str, str]:
    eq = tiles.EQUATOR
    gx = f"CAST(floor(({x} + {eq / 2.0}) / {eq} * CAST(1 << {z} AS DOUBLE) * 256.0) AS BIGINT)"
    gy = f"CAST(floor(({eq / 2.0} - {y}) / {eq} * CAST(1 << {z} AS DOUBLE) * 256.0) AS BIGINT)"
    return gx, gy


_GX, _GY = _pixel_sql("z", "x", "y")
HEAT = f"""heat AS (
  SELECT z, gx // 256 AS tx, gy // 256 AS ty, gx % 256 AS px, gy % 256 AS py, count(*) AS n
  FROM (SELECT z, {_GX} AS gx, {_GY} AS gy FROM pts, range({ZMIN}, {ZMAX + 1}) r(z))
  GROUP BY ALL)"""


def _extent_sql() -> str:
    return "ext AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts)"


def _tile_sql(v_x: str, v_y: str, z: str) -> tuple[str, str]:
    eq = tiles.EQUATOR
    return (f"CAST(trunc(({v_x} + {eq / 2.0}) / {eq} * CAST(1 << {z} AS DOUBLE)) AS INTEGER)",
            f"CAST(trunc(({eq / 2.0} - {v_y}) / {eq} * CAST(1 << {z} AS DOUBLE)) AS INTEGER)")


def _oracle() -> dict[str, str]:
    o = {}
    o["points"] = f"""WITH {PTS} SELECT event_id, lng, lat, sys_ms, area_code, company_code, num_bikes, date,
      round(x, 3) AS x, round(y, 3) AS y FROM pts"""
    o["time_range"] = f"WITH {PBM} SELECT event_id, sys_ms FROM pts WHERE {_range(YEAR_LO, YEAR_HI)}"
    o["hour_is"] = f"WITH {PTS} SELECT event_id, sys_ms FROM pts WHERE hr = 8"
    o["season_filter"] = f"""WITH {PBM} SELECT event_id, area_code, mon AS month FROM pts
      WHERE mon IN {WINTER} AND sys_ms <> 0 AND area_code IN {AREA_CODES_11}"""
    o["season_filter_alt"] = f"""WITH {PBM} SELECT event_id, area_code, mon AS month FROM pts
      WHERE mon IN {WINTER_ALT} AND sys_ms <> 0 AND area_code IN {AREA_CODES_10}"""
    o["within_bbox"] = f"WITH {PTS} SELECT event_id, lng, lat FROM pts WHERE {_bbox()}"
    o["category_filter"] = f"WITH {PTS} SELECT event_id, company_code FROM pts WHERE company_code IN {CATEGORIES}"
    o["swap_columns"] = f"WITH {POIS} SELECT lat, lng FROM pois"
    o["counts_per_second"] = f"""WITH {PTS} SELECT strftime(ts, '%Y-%m-%d-%H:%M:%S') AS date, count(*) AS count
      FROM pts WHERE strftime(ts, '%Y-%m-%d-%H:%M:%S') <= '{SECOND_BOUND}' GROUP BY 1 ORDER BY 1"""
    o["count_by"] = f"WITH {PTS} SELECT company_code, count(*) AS count FROM pts GROUP BY 1"
    o["count_by_month"] = f"WITH {PBM} SELECT mon AS month, count(*) AS count FROM pts GROUP BY 1"
    o["count_by_area_company"] = f"WITH {PTS} SELECT area_code, company_code, count(*) AS count FROM pts GROUP BY 1, 2"
    o["monthly_sum"] = f"""WITH {PTS} SELECT CAST(year(CAST(date AS DATE)) AS INTEGER) AS year,
      CAST(month(CAST(date AS DATE)) AS INTEGER) AS month, CAST(sum(num_bikes) AS BIGINT) AS sum_bikes
      FROM pts GROUP BY 1, 2 ORDER BY 1, 2"""
    o["monthly_sum_orders"] = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
      CAST(sum(CAST(trunc(o_totalprice / 1000.0) AS INTEGER)) AS BIGINT) AS sum_bikes FROM orders GROUP BY 1, 2 ORDER BY 1, 2"""
    o["geohash_hourly_counts"] = f"""WITH {PTS} SELECT {_geohash_sql('lng', 'lat', 8)} AS envelope,
      strftime(ts, '%Y-%m-%d-%H') AS date, count(*) AS count FROM pts WHERE {_range(START, END)} GROUP BY 1, 2"""
    o["geohash_hourly_counts_stream"] = o["geohash_hourly_counts"]
    minx, miny, maxx, maxy = GRID_ENVELOPE
    dx, dy = (maxx - minx) / GRID_NX, (maxy - miny) / GRID_NY
    cell = (f"CAST(least(floor((lng - {minx}) / {dx}), {GRID_NX - 1}) AS BIGINT) * {GRID_NY}"
            f" + CAST(least(floor((lat - {miny}) / {dy}), {GRID_NY - 1}) AS BIGINT)")
    inside = f"lng >= {minx} AND lng <= {maxx} AND lat >= {miny} AND lat <= {maxy}"
    o["equal_grid_counts"] = f"WITH {PTS} SELECT {cell} AS cell, count(*) AS count FROM pts WHERE {inside} GROUP BY 1"
    o["equal_grid_hourly_counts"] = f"""WITH {PTS},
      c AS (SELECT sys_ms // 3600000 AS h, {cell} AS cell, count(*) AS n FROM pts
            WHERE {inside} AND {_range(START, END)} AND sys_ms % 3600000 <> 0 GROUP BY 1, 2),
      hours AS (SELECT DISTINCT h FROM c),
      cells AS (SELECT range AS cell FROM range({GRID_NX * GRID_NY}))
      SELECT strftime(make_timestamp(hours.h * 3600000000), '%Y-%m-%d-%H') AS hour, cells.cell,
        CAST(coalesce(c.n, 0) AS BIGINT) AS count
      FROM hours CROSS JOIN cells LEFT JOIN c ON c.h = hours.h AND c.cell = cells.cell"""
    fdx, fdy = (maxx - minx) / FINE_NX, (maxy - miny) / FINE_NY
    fine = (f"CAST(least(floor((lng - {minx}) / {fdx}), {FINE_NX - 1}) AS BIGINT) * {FINE_NY}"
            f" + CAST(least(floor((lat - {miny}) / {fdy}), {FINE_NY - 1}) AS BIGINT)")
    o["fine_grid_hourly_counts"] = f"""WITH {PTS},
      c AS (SELECT sys_ms // 3600000 AS h, {fine} AS cell, count(*) AS n FROM pts
            WHERE {inside} AND {_range(START, END)} AND sys_ms % 3600000 <> 0 GROUP BY 1, 2),
      hours AS (SELECT DISTINCT h FROM c),
      cells AS (SELECT range AS cell FROM range({FINE_NX * FINE_NY}))
      SELECT strftime(make_timestamp(hours.h * 3600000000), '%Y-%m-%d-%H') AS hour, cells.cell,
        CAST(coalesce(c.n, 0) AS BIGINT) AS count
      FROM hours CROSS JOIN cells LEFT JOIN c ON c.h = hours.h AND c.cell = cells.cell"""
    o["extent"] = f"""WITH {PTS} SELECT round(min(x), 3) AS minx, round(min(y), 3) AS miny, round(max(x), 3) AS maxx,
      round(max(y), 3) AS maxy, count(*) AS count FROM pts"""
    circle = f"""WITH {PTS}, {POIS},
      pairs AS (SELECT w.lng AS poi_lng, w.lat AS poi_lat, p.lng, p.lat FROM pts p, poism w WHERE {DIST} <= {R_POI}),
      cnt AS (SELECT poi_lng, poi_lat, count(DISTINCT (lng, lat)) AS n FROM pairs GROUP BY 1, 2)"""
    area = math.pi * R_POI * R_POI
    o["poi_circle_counts"] = circle + " SELECT * FROM cnt"
    o["join_cardinality"] = circle + " SELECT count(*) AS n_windows FROM (SELECT DISTINCT poi_lng, poi_lat FROM pairs)"
    o["join_members"] = circle + " SELECT DISTINCT poi_lng, poi_lat, lng, lat FROM pairs"
    dens = f"round(n / {area!r} * 1e6, 9)"
    o["density_rank"] = circle + f" SELECT poi_lng, poi_lat, n, {dens} AS density FROM cnt ORDER BY n / {area!r} DESC, poi_lng, poi_lat"
    o["top_density"] = circle + f" SELECT poi_lng, poi_lat, n, {dens} AS density FROM cnt ORDER BY n / {area!r} DESC, poi_lng, poi_lat LIMIT {TOP}"
    o["top_count"] = circle + f" SELECT poi_lng, poi_lat, n FROM cnt ORDER BY n DESC, poi_lng, poi_lat LIMIT {TOP}"
    road = f"""WITH {PTS}, {ROAD_SEGS},
      d AS (SELECT s.id, p.event_id, p.lng, p.lat, p.date, p.sys_ms, min({SEG_DIST}) AS dist
            FROM pts p, road_segs s GROUP BY ALL)"""
    o["road_pairs_dedupe"] = road + f" SELECT DISTINCT id, lng, lat FROM d WHERE dist < {R_ROAD}"
    o["road_pairs"] = road + f" SELECT id, event_id FROM d WHERE dist < {R_ROAD_SMALL}"
    o["road_daily_counts"] = road + f""" SELECT id, date, count(*) AS count FROM d
      WHERE dist < {R_ROAD} AND {_range(START, END)} GROUP BY 1, 2 ORDER BY date, id"""
    o["road_daily_counts_unsorted"] = road + f""" SELECT id, date, count(*) AS count FROM d
      WHERE dist < {R_ROAD} AND {_range(START, END)} GROUP BY 1, 2"""
    o["poi_daily_counts"] = f"""WITH {PTS}, {POIS} SELECT w.objectid, p.date, count(*) AS join_count
      FROM pts p, poism w WHERE {_range(START, END, 'p.sys_ms')} AND {_bbox('p.lng', 'p.lat')} AND {DIST} <= {R_POI}
      GROUP BY 1, 2 ORDER BY 2, 1"""
    o["poi_daily_counts_by_date"] = f"""WITH {PTS}, {POIS} SELECT p.date, count(*) AS join_count
      FROM pts p, poism w WHERE {_range(START, END, 'p.sys_ms')} AND {_bbox('p.lng', 'p.lat')} AND {DIST} <= {R_POI}
      GROUP BY 1 ORDER BY 1"""
    near = f"""near AS (SELECT w.objectid, w.x, w.y, c.day_ms FROM poism w, casesm c
        WHERE sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)) <= {R2_EXPO})"""
    o["exposure_counts"] = f"""WITH {PTS}, {POIS}, {CASES}, {near}
      SELECT w.objectid, p.date, count(*) AS join_count FROM pts p, near w
      WHERE {_range(START, END, 'p.sys_ms')} AND {_bbox('p.lng', 'p.lat')} AND {DIST} <= {R_EXPO}
        AND p.sys_ms >= w.day_ms - 864000000 AND p.sys_ms <= w.day_ms + 864000000
      GROUP BY 1, 2 ORDER BY 2, 1"""
    o["pois_near_cases"] = f"WITH {POIS}, {CASES}, {near} SELECT DISTINCT objectid FROM near"
    o["pois_far_from_cases"] = f"WITH {POIS}, {CASES}, {near} SELECT objectid FROM pois WHERE objectid NOT IN (SELECT objectid FROM near)"
    o["poi_case_distances"] = f"""WITH {POIS}, {CASES} SELECT w.objectid, c.case_id,
      round(sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)), 3) AS distance FROM poism w, casesm c
      WHERE sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)) <= {R2_EXPO}"""
    o["labeled_area_counts"] = f"""WITH {PTS}, {AREAS} SELECT p.date, count(*) AS join_count FROM pts p, areas a
      WHERE {_range(START, END, 'p.sys_ms')} AND p.hr = 8 AND abs(p.x - a.cx) < 600 AND abs(p.y - a.cy) < 600
        AND NOT (p.y - a.cy >= abs(p.x - a.cx)) GROUP BY 1 ORDER BY 1"""
    fish_in = "p.x > f.minx AND p.x < f.minx + 1000.0 AND p.y > f.miny AND p.y < f.miny + 1000.0"
    o["fishnet_daily_counts"] = f"""WITH {PTS}, {FISHNET} SELECT f.oid, p.date, count(*) AS join_count
      FROM pts p, fishnet f WHERE {_range(START, END, 'p.sys_ms')} AND p.sys_ms % 86400000 <> 0 AND {fish_in}
      GROUP BY 1, 2"""
    o["fishnet_counts"] = f"""WITH {PTS}, {FISHNET} SELECT f.oid, count(DISTINCT (p.x, p.y)) AS n_points
      FROM pts p, fishnet f WHERE {_range(START, END, 'p.sys_ms')} AND {fish_in} GROUP BY 1"""
    o["fishnet_daily_counts_stream"], o["fishnet_counts_stream"] = o["fishnet_daily_counts"], o["fishnet_counts"]
    o["regular_fishnet_counts"] = o["fishnet_counts"]
    o["to_utm"] = f"WITH {PTS}, {_utm_sql()}"
    dlng, dlat = _gcj_delta_sql("lng", "lat")
    o["gcj_delta"] = f"WITH {PTS} SELECT event_id, round({dlng}, 9) AS dlng, round({dlat}, 9) AS dlat FROM pts"
    o["gcj_to_wgs"] = (f"WITH {PTS}, {_gcj_iter_sql()} SELECT event_id, round(wlng, 8) AS wgs_lng, "
                       f"round(wlat, 8) AS wgs_lat FROM g{crs.GCJ_MAX_STEPS}")
    o["gcj_to_wgs_fold"] = o["gcj_to_wgs"]
    o["project_points"] = f"WITH {POIS} SELECT objectid, name, lng, lat, round(x, 3) AS x, round(y, 3) AS y FROM poism"
    o["geohash_encode"] = f"WITH {PTS} SELECT event_id, {_geohash_sql('lng', 'lat', 8)} AS geohash FROM pts"
    gb = "gb AS (SELECT event_id, qx, qy FROM (SELECT event_id, {qx} AS qx, {qy} AS qy FROM pts))"
    n6x, n6y = 15, 15
    qx6 = f"CAST(least(greatest(ceil((lng + 180.0) / 360.0 * {float(1 << n6x)}) - 1, 0), {(1 << n6x) - 1}) AS BIGINT)"
    qy6 = f"CAST(least(greatest(ceil((lat + 90.0) / 180.0 * {float(1 << n6y)}) - 1, 0), {(1 << n6y) - 1}) AS BIGINT)"
    o["geohash_bounds"] = f"""WITH {PTS}, {gb.format(qx=qx6, qy=qy6)} SELECT event_id,
      round(-180.0 + (2.0 * qx + 1.0) * CAST({180.0 / (1 << n6x)!r} AS DOUBLE), 9) AS lng,
      round(-90.0 + (2.0 * qy + 1.0) * CAST({90.0 / (1 << n6y)!r} AS DOUBLE), 9) AS lat,
      round(CAST({180.0 / (1 << n6x)!r} AS DOUBLE), 12) AS lng_err, round(CAST({90.0 / (1 << n6y)!r} AS DOUBLE), 12) AS lat_err FROM gb"""
    qx8 = "CAST(least(greatest(ceil((lng + 180.0) / 360.0 * 1048576.0) - 1, 0), 1048575) AS BIGINT)"
    qy8 = "CAST(least(greatest(ceil((lat + 90.0) / 180.0 * 1048576.0) - 1, 0), 1048575) AS BIGINT)"
    ex, ey = f"CAST({180.0 / (1 << 20)!r} AS DOUBLE)", f"CAST({90.0 / (1 << 20)!r} AS DOUBLE)"
    o["point_rectangles"] = f"""WITH {PTS}, {gb.format(qx=qx8, qy=qy8)} SELECT event_id,
      round(-180.0 + (2.0 * qx + 1.0) * {ex} + {ex}, 9) AS max_lng, round(-90.0 + (2.0 * qy + 1.0) * {ey} + {ey}, 9) AS max_lat,
      round(-180.0 + (2.0 * qx + 1.0) * {ex} - {ex}, 9) AS min_lng, round(-90.0 + (2.0 * qy + 1.0) * {ey} - {ey}, 9) AS min_lat FROM gb"""
    o["geom_from_wkt"] = f"""WITH {ROAD_SEGS} SELECT id, 'LINESTRING' AS kind, CAST(count(*) + 1 AS INTEGER) AS n_vertices,
      min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy
      FROM road_segs GROUP BY id"""
    v = lambda a, b: f"CAST(CAST({a} AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST({b} AS BIGINT) AS VARCHAR)"
    ring = " || ', ' || ".join(v(a, b) for a, b in (("cx - 600", "cy - 600"), ("cx + 600", "cy - 600"), ("cx + 600", "cy + 600"),
                                                     ("cx", "cy"), ("cx - 600", "cy + 600"), ("cx - 600", "cy - 600")))
    o["geom_to_wkt"] = f"WITH {AREAS} SELECT id, 'POLYGON ((' || {ring} || '))' AS wkt FROM areas"
    o["area"] = f"WITH {AREAS} SELECT id, round(1080000.0, 3) AS area FROM areas"
    o["line_buffer"] = f"""WITH {ROAD_SEGS} SELECT id, CAST(count(*) AS INTEGER) AS n_parts,
      CAST(count(*) * 35 AS INTEGER) AS n_vertices FROM road_segs GROUP BY id"""
    cminx, cminy, cmaxx, cmaxy = CONTAIN_ENV
    o["envelope_contains"] = f"""WITH {ROAD_SEGS} SELECT id FROM road_segs GROUP BY id
      HAVING min(least(x1, x2)) >= {cminx} AND max(greatest(x1, x2)) <= {cmaxx}
         AND min(least(y1, y2)) >= {cminy} AND max(greatest(y1, y2)) <= {cmaxy}
         AND bool_or((x1 > {cminx} AND x1 < {cmaxx} AND y1 > {cminy} AND y1 < {cmaxy})
                  OR (x2 > {cminx} AND x2 < {cmaxx} AND y2 > {cminy} AND y2 < {cmaxy})
                  OR ((x1 + x2) / 2 > {cminx} AND (x1 + x2) / 2 < {cmaxx} AND (y1 + y2) / 2 > {cminy} AND (y1 + y2) / 2 < {cmaxy}))"""
    o["line_buffer_cover"] = road + f" SELECT id, count(*) AS n_inner, 0 AS n_missed, 0 AS n_outside FROM d WHERE dist < {R_ROAD_SMALL * math.cos(math.pi / 32)!r} GROUP BY 1"
    bad = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(lat, 9) END AS lat"
    o["dissolved_buffer_cover"] = road + f" SELECT id, count(*) AS n_inner, 0 AS n_missed, 0 AS n_outside FROM d WHERE dist < {R_ROAD_SMALL * math.cos(math.pi / (4 * buffers.STEPS))!r} GROUP BY 1"
    bad = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(lat, 9) END AS lat"
    o["csv_points"] = f"WITH {PTS} SELECT event_id, round(lng, 9) AS lng, {bad}, sys_ms, company_code FROM pts"
    # concat_ws leaves out a null: one field too few; with one too many besides the count is right again
    short, more = "event_id % 13 = 0", "event_id % 11 = 0"
    is_bad = f"(event_id % 7 = 0 OR (({short}) <> ({more})))"
    code = f"CASE WHEN NOT ({short}) THEN company_code WHEN {more} THEN 'more' END"
    checked = f"""ck AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN round(lng, 9) END AS lng, {bad}, sys_ms, {code} AS company_code, {is_bad} AS is_bad FROM pts)"""
    o["csv_points_checked"] = f"WITH {PTS}, {checked} SELECT * FROM ck"
    o["csv_points_accounted"] = f"""WITH {PTS}, {checked} SELECT count(*) AS n_rows, count(*) FILTER (NOT is_bad) AS n_good, count(*) FILTER (is_bad) AS n_bad,
      count(*) FILTER (NOT is_bad AND lng IS NULL) AS n_no_lng, count(*) FILTER (NOT is_bad AND company_code IS NULL) AS n_no_company_code FROM ck"""
    o["csv_points_by_position"] = f"WITH {PTS} SELECT event_id, round(lng, 9) AS lng, {bad} FROM pts"
    o["csv_points_inferred"] = f"WITH {PTS} SELECT event_id, round(lng, 9) AS lng, sys_ms FROM pts"
    o["shifted_untimed_points"] = f"""WITH {PTS}, {_gcj_iter_sql()} SELECT event_id, round(wlng, 8) AS lng, round(wlat, 8) AS lat,
      round(wlng * 20037508.342789244 / 180.0, 2) AS x, round(ln(tan((90.0 + wlat) * pi() / 360.0)) * 6378137.0, 2) AS y
      FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN wlng END AS wlng, CASE WHEN event_id % 7 <> 0 THEN wlat END AS wlat FROM g{crs.GCJ_MAX_STEPS})"""
    o["wkt_table"] = """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN 'LINESTRING' END AS kind,
      CAST(CASE WHEN p_partkey % 10 <> 0 THEN 5 END AS INTEGER) AS n_vertices FROM part"""
    o["text_lines"] = f"WITH {PTS} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN company_code ELSE '' END AS company_code, event_id AS again, 3 AS n_fields FROM pts"
    o["sorted_text"] = f"WITH {POIS} SELECT name || ',' || CAST(objectid AS VARCHAR) AS value, row_number() OVER (ORDER BY name) AS place FROM pois"
    for name, cte, key, cond in (("month_folders", PBM, "CAST(mon AS VARCHAR) AS month", "true"), ("date_folders", PTS, "date", "true"),
                                 ("hour_folders", PTS, "strftime(ts, '%Y-%m-%d-%H') AS date_hour", "true"), ("year_folders", PBM, "CAST(year(ts) AS VARCHAR) AS year", "true")):
        o[name] = f"WITH {cte} SELECT {key}, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM pts WHERE {cond} GROUP BY 1"
    o["numbered_points"] = f"WITH {PTS} SELECT event_id, row_number() OVER (ORDER BY sys_ms, event_id DESC) AS place FROM pts"
    o["time_range_seconds"] = f"WITH {PTS} SELECT event_id, sys_ms FROM pts WHERE {_range(*SECONDS)}"
    winter = ", ".join(map(str, WINTER))
    o["winter_points_headerless"] = f"WITH {PBM} SELECT event_id, mon AS month FROM pts WHERE mon IN ({winter}) AND sys_ms <> 0"
    o["sql_utm_points"] = f"SELECT * FROM ({o['to_utm']}) JOIN (WITH {PTS} SELECT event_id FROM pts WHERE {_range(START, END)}) USING (event_id)"
    o["sql_shifted_points"] = f"SELECT * FROM ({o['gcj_to_wgs']}) JOIN (WITH {PTS} SELECT event_id FROM pts WHERE {_range(START, END)}) USING (event_id)"
    o["sql_road_daily_counts"] = o["road_daily_counts_unsorted"]
    o["sql_poi_daily_counts"] = o["poi_daily_counts"]
    # windows that share places and ids
    shared_pois = POIS.replace("s_suppkey", "s_suppkey % 7").replace("s_suppkey % 7 AS objectid", "s_suppkey AS objectid")
    o["poi_circle_counts_shared"] = f"""WITH {PTS}, {shared_pois} SELECT w.lng AS poi_lng, w.lat AS poi_lat, count(DISTINCT (p.lng, p.lat)) AS n
      FROM pts p, poism w WHERE {DIST} <= {R_POI} GROUP BY 1, 2"""
    shared_segs = f"""road_segs AS (SELECT fid, id % 100 AS id, k, x1, y1, x2, y2 FROM (
      {ROAD_SEGS[ROAD_SEGS.index('SELECT'):ROAD_SEGS.rindex(')')].replace('p_partkey AS id', 'p_partkey AS fid, p_partkey % 150 AS id').replace('p_partkey*', '(p_partkey % 150)*')}))"""
    shared = f"""WITH {PTS}, {shared_segs},
      d AS (SELECT s.fid, s.id, p.event_id, p.lng, p.lat, p.date, p.sys_ms, min({SEG_DIST}) AS dist FROM pts p, road_segs s GROUP BY ALL)"""
    o["road_pairs_shared"] = shared + f" SELECT id, event_id FROM d WHERE dist < {R_ROAD_SMALL}"
    o["road_pairs_dedupe_shared"] = shared + f" SELECT DISTINCT id, lng, lat FROM d WHERE dist < {R_ROAD_SMALL}"
    o["road_daily_counts_shared"] = shared + f" SELECT id, date, count(*) AS count FROM d WHERE dist < {R_ROAD_SMALL} AND {_range(START, END)} GROUP BY 1, 2"
    # the area of a road's buffer by the rule of the operator: scan lines radius / 32 apart, covered length of each
    h, r = R_ROAD / 32, R_ROAD
    vert = "CAST(CAST({0} AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST({1} AS BIGINT) AS VARCHAR)"
    windows = f"""wsegs AS (SELECT fid, any_value(id) AS id, k, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2 FROM road_segs GROUP BY fid, k),
      lines AS (SELECT fid, any_value(id) AS id, 'LINESTRING (' || string_agg({vert.format('x1', 'y1')}, ', ' ORDER BY k) || ', ' || max(CASE WHEN k = 3 THEN {vert.format('x2', 'y2')} END) || ')' AS wkt FROM wsegs GROUP BY fid),
      uniq AS (SELECT id, wkt, min(fid) AS fid FROM lines GROUP BY id, wkt),
      sl AS (SELECT s.fid, s.*, CAST(kk AS BIGINT) AS line, (kk + 0.5) * {h} AS y, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len
             FROM wsegs s, LATERAL (SELECT unnest(generate_series(CAST(floor((least(y1, y2) - {r}) / {h}) AS BIGINT), CAST(floor((greatest(y1, y2) + {r}) / {h}) AS BIGINT))) AS kk)),
      nrm AS (SELECT *, -(y2 - y1) / len * {r} AS nx, (x2 - x1) / len * {r} AS ny FROM sl),
      ext AS (SELECT fid, line, unnest([
          CASE WHEN abs(y - y1) <= {r} THEN x1 - sqrt({r * r} - (y - y1) * (y - y1)) END, CASE WHEN abs(y - y1) <= {r} THEN x1 + sqrt({r * r} - (y - y1) * (y - y1)) END,
          CASE WHEN abs(y - y2) <= {r} THEN x2 - sqrt({r * r} - (y - y2) * (y - y2)) END, CASE WHEN abs(y - y2) <= {r} THEN x2 + sqrt({r * r} - (y - y2) * (y - y2)) END,
          CASE WHEN (y1 + ny > y) <> (y2 + ny > y) THEN x1 + nx + (y - y1 - ny) / (y2 - y1) * (x2 - x1) END,
          CASE WHEN (y1 - ny > y) <> (y2 - ny > y) THEN x1 - nx + (y - y1 + ny) / (y2 - y1) * (x2 - x1) END]) AS x, k FROM nrm),
      iv AS (SELECT fid, line, k, min(x) AS l, max(x) AS rr FROM ext WHERE x IS NOT NULL GROUP BY 1, 2, 3),
      run AS (SELECT *, max(rr) OVER (PARTITION BY fid, line ORDER BY l, rr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv),
      area AS (SELECT fid, sum(greatest(0, rr - greatest(l, coalesce(upto, l)))) * {h} AS area FROM run GROUP BY fid),
      lw AS (SELECT u.id, u.wkt, count(DISTINCT (d.lng, d.lat)) AS n, round(any_value(a.area), 3) AS area
             FROM uniq u JOIN d ON d.fid = u.fid AND d.dist < {r} JOIN area a ON a.fid = u.fid GROUP BY 1, 2)"""
    lines = f"{shared}, {windows}"
    o["line_density_rank"] = lines + " SELECT id, wkt, n, area, round(n / area * 1e6, 6) AS density FROM lw"
    o["line_top_density"] = lines + f""" SELECT id, wkt, n, area, round(n / area * 1e6, 6) AS density, row_number() OVER (ORDER BY n / area DESC, id, wkt) AS rank
      FROM lw QUALIFY rank <= {TOP}"""
    o["line_top_count"] = lines + f" SELECT id, wkt, n FROM lw ORDER BY n DESC, id, wkt LIMIT {TOP}"
    near_road = f"SELECT p.event_id FROM pts p, road_segs s WHERE {SEG_DIST} < {R_ROAD_SMALL}"
    o["points_on_roads"] = f"WITH {PTS}, {ROAD_SEGS} SELECT event_id, sys_ms FROM pts WHERE event_id IN ({near_road})"
    o["points_off_roads"] = f"WITH {PTS}, {ROAD_SEGS} SELECT event_id, sys_ms FROM pts WHERE event_id NOT IN ({near_road})"
    o["line_cardinality"] = lines + " SELECT count(*) AS n_windows FROM lw"
    o["line_members"] = lines + f" SELECT DISTINCT l.id, l.wkt, d.lng, d.lat FROM lines l JOIN d ON d.fid = l.fid WHERE d.dist < {R_ROAD_SMALL}"
    # polygons with holes of different sizes: a square ring around a centre, its area and its points in closed form
    holed = """harea AS (SELECT p_partkey AS id, CAST(12935000 + (p_partkey*6113) % 31000 AS DOUBLE) AS cx, CAST(4841000 + (p_partkey*9973) % 26000 AS DOUBLE) AS cy,
        CAST(300 + (p_partkey*37) % 500 AS DOUBLE) AS ro, CAST(50 + (p_partkey*53) % 200 AS DOUBLE) AS ri FROM part),
      hw AS (SELECT *, 'POLYGON ((' || {0} || '), (' || {1} || '))' AS wkt, 4 * ro * ro - 4 * ri * ri AS area FROM harea)""".format(
        *[" || ', ' || ".join(vert.format(f"cx {a} {k}", f"cy {b} {k}") for a, b in corners) for k, corners in (("ro", ("--", "+-", "++", "-+", "--")), ("ri", ("--", "-+", "++", "+-", "--")))])
    inside = "greatest(abs(p.x - w.cx), abs(p.y - w.cy)) < w.ro AND greatest(abs(p.x - w.cx), abs(p.y - w.cy)) > w.ri"
    polys = f"""WITH {PTS}, {holed}, pw AS (SELECT w.id, w.wkt, count(DISTINCT (p.lng, p.lat)) AS n, any_value(w.area) AS area FROM pts p, hw w WHERE {inside} GROUP BY 1, 2)"""
    o["polygon_density_rank"] = polys + " SELECT id, wkt, n, area, round(n / area * 1e6, 6) AS density FROM pw"
    o["polygon_top_density"] = polys + f""" SELECT id, wkt, n, area, round(n / area * 1e6, 6) AS density, row_number() OVER (ORDER BY n / area DESC, id, wkt) AS rank
      FROM pw QUALIFY rank <= {TOP}"""
    o["polygon_top_count"] = polys + f" SELECT id, wkt, n FROM pw ORDER BY n DESC, id, wkt LIMIT {TOP}"
    o["polygon_cardinality"] = polys + " SELECT count(*) AS n_windows FROM pw"
    held = f"SELECT p.event_id FROM pts p, hw w WHERE {inside}"
    o["points_in_areas"] = f"WITH {PTS}, {holed} SELECT event_id, sys_ms FROM pts WHERE event_id IN ({held})"
    o["points_outside_areas"] = f"WITH {PTS}, {holed} SELECT event_id, sys_ms FROM pts WHERE event_id NOT IN ({held})"
    turned = holed.replace(" AS wkt,", " AS w0,").replace("FROM harea)", "FROM harea)")
    shell, hole = [" || ', ' || ".join(vert.format(f"cx {a} {k}", f"cy {b} {k}") for a, b in corners) for k, corners in (("ro", ("--", "-+", "++", "+-", "--")), ("ri", ("--", "+-", "++", "-+", "--")))]
    o["shapefile_areas"] = f"WITH {turned} SELECT id, 'POLYGON ((' || {shell} || '), (' || {hole} || '))' AS wkt, cx - ro AS minx, cy + ro AS maxy FROM hw"
    x0, y0, x1, y1 = SHAPE_BOX
    o["shapefile_roads_in_box"] = f"""WITH {ROAD_SEGS} SELECT id, 'LINESTRING' AS kind, 5 AS n_vertices FROM road_segs GROUP BY id
      HAVING min(least(x1, x2)) <= {x1} AND max(greatest(x1, x2)) >= {x0} AND min(least(y1, y2)) <= {y1} AND max(greatest(y1, y2)) >= {y0}"""
    o["polygon_members"] = f"WITH {PTS}, {holed} SELECT DISTINCT w.id, p.lng, p.lat FROM pts p, hw w WHERE {inside}"
    o["area_holed"] = f"WITH {holed} SELECT id, round(area, 3) AS area FROM hw"
    o["sql_area_daily_counts"] = f"""WITH {PTS}, {holed} SELECT w.id, p.date, count(*) AS join_count, any_value(w.area) AS area FROM pts p, hw w
      WHERE {_range(START, END, 'p.sys_ms')} AND {inside} GROUP BY 1, 2"""
    utm = _utm_sql(rounded=False)
    net = f"""unet AS (SELECT range AS oid, {UTM_X0} + CAST(range % {UTM_NX} AS DOUBLE) * {UTM_CELL} AS minx, {UTM_Y0} + CAST(range // {UTM_NX} AS DOUBLE) * {UTM_CELL} AS miny FROM range({UTM_NX * UTM_NY}))"""
    in_net = f"u.easting > f.minx AND u.easting < f.minx + {UTM_CELL} AND u.northing > f.miny AND u.northing < f.miny + {UTM_CELL}"
    o["utm_fishnet_daily_counts"] = f"""WITH {PTS}, {utm}, {net} SELECT f.oid, p.date, count(*) AS join_count FROM pts p JOIN utm u USING (event_id), unet f
      WHERE {_range(START, END, 'p.sys_ms')} AND p.sys_ms % 86400000 <> 0 AND {in_net} GROUP BY 1, 2"""
    o["utm_fishnet_counts"] = f"""WITH {PTS}, {utm}, {net} SELECT f.oid, count(DISTINCT (u.easting, u.northing)) AS n_points FROM pts p JOIN utm u USING (event_id), unet f
      WHERE {_range(START, END, 'p.sys_ms')} AND {in_net} GROUP BY 1"""
    hx0, hy0, hx1, hy1 = HEAT_REGION
    o["shifted_heat_pixels"] = f"""WITH {PTS}, {_gcj_iter_sql()},
      sp AS (SELECT wlng * 20037508.342789244 / 180.0 AS x, ln(tan((90.0 + wlat) * pi() / 360.0)) * 6378137.0 AS y FROM g{crs.GCJ_MAX_STEPS}),
      heat AS (SELECT z, gx // 256 AS tx, gy // 256 AS ty, gx % 256 AS px, gy % 256 AS py, count(*) AS n FROM (SELECT z, {_GX} AS gx, {_GY} AS gy
        FROM sp, range({ZMIN}, {ZMAX + 1}) r(z) WHERE x >= {hx0} AND x <= {hx1} AND y >= {hy0} AND y <= {hy1}) GROUP BY ALL)
      SELECT CAST(z AS INTEGER) AS z, tx, ty, px, py, n, least(n, 2) / 2.0 AS value FROM heat"""
    z = ZOOM
    o["tile_of_lonlat"] = f"""WITH {PTS} SELECT event_id, {z} AS z,
      CAST(trunc((lng + 180.0) / 360.0 * {float(1 << z)}) AS INTEGER) AS tx,
      CAST(trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * {float(1 << z)}) AS INTEGER) AS ty FROM pts"""
    tx, ty = _tile_sql("x", "y", str(z))
    o["tile_of_mercator"] = f"WITH {PTS} SELECT event_id, {z} AS z, {tx} AS tx, {ty} AS ty FROM pts"
    ptiles = f"pt AS (SELECT DISTINCT {tx} AS tx, {ty} AS ty FROM pts)"
    eq = tiles.EQUATOR
    o["tile_to_lonlat"] = f"""WITH {PTS}, {ptiles} SELECT tx, ty,
      round(CAST(tx AS DOUBLE) / {float(1 << z)} * 360.0 - 180.0, 9) AS lng,
      round(degrees(atan(sinh(pi() * (1.0 - 2.0 * CAST(ty AS DOUBLE) / {float(1 << z)})))), 9) AS lat FROM pt"""
    o["tile_to_mercator"] = f"""WITH {PTS}, {ptiles} SELECT tx, ty,
      round(CAST(tx AS DOUBLE) * {eq} / {float(1 << z)} - {eq / 2.0}, 3) AS mx,
      round({eq / 2.0} - CAST(ty AS DOUBLE) * {eq} / {float(1 << z)}, 3) AS my FROM pt"""
    o["tile_path"] = f"""WITH {PTS}, {ptiles} SELECT tx, ty,
      '{z}/' || CAST(tx AS VARCHAR) || '/' || CAST(ty AS VARCHAR) || '.png' AS path FROM pt"""
    t1x, t1y = _tile_sql("minx", "maxy", "z")
    t2x, t2y = _tile_sql("maxx", "miny", "z")
    o["tile_offsets"] = f"""WITH {PTS}, {_extent_sql()} SELECT CAST(z AS INTEGER) AS z, {t1x} AS tx, {t1y} AS ty
      FROM ext, range(0, {ZMAX + 1}) r(z)"""
    o["tile_bounds"] = f"""WITH {PTS}, {_extent_sql()}, tb AS (SELECT CAST(z AS INTEGER) AS z, {t1x} AS x1, {t1y} AS y1,
        {t2x} + 1 AS x2, {t2y} + 1 AS y2 FROM ext, range(0, {ZMAX + 1}) r(z))
      SELECT z, round(CAST(x1 AS DOUBLE) * {eq} / CAST(1 << z AS DOUBLE) - {eq / 2.0}, 3) AS west,
        round({eq / 2.0} - CAST(y1 AS DOUBLE) * {eq} / CAST(1 << z AS DOUBLE), 3) AS north,
        round(CAST(x2 AS DOUBLE) * {eq} / CAST(1 << z AS DOUBLE) - {eq / 2.0}, 3) AS east,
        round({eq / 2.0} - CAST(y2 AS DOUBLE) * {eq} / CAST(1 << z AS DOUBLE), 3) AS south FROM tb"""
    o["heat_pixels"] = f"""WITH {PTS}, {HEAT} SELECT CAST(z AS INTEGER) AS z, tx, ty, px, py, n,
      least(n, 2) / 2.0 AS value FROM heat"""
    o["blur_pixels"] = f"""WITH {PTS}, {HEAT},
      g AS (SELECT z, tx * 256 + px AS gx, ty * 256 + py AS gy, n FROM heat),
      b AS (SELECT z, gx + dx AS gx, gy + dy AS gy, sum(n) / 9.0 AS v FROM g, range(-1, 2) a(dx), range(-1, 2) c(dy) GROUP BY ALL)
      SELECT CAST(z AS INTEGER) AS z, gx // 256 AS tx, gy // 256 AS ty, gx % 256 AS px, gy % 256 AS py,
        round(least(v, 2.0) / 2.0, 9) AS value FROM b WHERE gx >= 0 AND gy >= 0"""
    sgx1, sgy1 = (f"(s.x1 + {eq / 2.0}) / {eq} * CAST(1 << z AS DOUBLE) * 256.0",
                  f"({eq / 2.0} - s.y1) / {eq} * CAST(1 << z AS DOUBLE) * 256.0")
    sgx2, sgy2 = (f"(s.x2 + {eq / 2.0}) / {eq} * CAST(1 << z AS DOUBLE) * 256.0",
                  f"({eq / 2.0} - s.y2) / {eq} * CAST(1 << z AS DOUBLE) * 256.0")
    o["line_pixels"] = f"""WITH {ROAD_SEGS},
      sg AS (SELECT z, {sgx1} AS gx1, {sgy1} AS gy1, {sgx2} AS gx2, {sgy2} AS gy2 FROM road_segs s, range({ZMIN}, {ZMAX + 1}) r(z)),
      st AS (SELECT *, CAST(ceil(greatest(abs(gx2 - gx1), abs(gy2 - gy1))) AS BIGINT) AS n FROM sg),
      px AS (SELECT DISTINCT z, CAST(floor(CASE WHEN n = 0 THEN gx1 ELSE gx1 + (gx2 - gx1) * k / n END) AS BIGINT) AS gx,
                    CAST(floor(CASE WHEN n = 0 THEN gy1 ELSE gy1 + (gy2 - gy1) * k / n END) AS BIGINT) AS gy
             FROM st, LATERAL (SELECT unnest(generate_series(0, n)) AS k))
      SELECT CAST(z AS INTEGER) AS z, gx // 256 AS tx, gy // 256 AS ty, gx % 256 AS px, gy % 256 AS py FROM px"""
    o["tile_summary"] = f"""WITH {PTS}, {HEAT} SELECT CAST(z AS INTEGER) AS z, tx, ty, count(*) AS n_pixels,
      CAST(sum(n) AS BIGINT) AS n_points, max(least(n, 2) / 2.0) AS max_value FROM heat GROUP BY ALL"""
    return o


ORACLE = _oracle()
