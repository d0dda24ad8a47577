"""The reference's analyses as composed DataFrame plans.

Filters first (pushed to the scan where the source allows), then the cell
equi-join, then a partial+final aggregate. The window side (small) is prepared
by jobs that run when a function is called: it is measured and written to the
shared checkpoint folder; the points are read by the returned plan alone, once.
Driver-side loops over days and hours in the reference become one grouped pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geom as G
from ..functions import timefns as TF
from ..operators import cells as C
from ..operators import counts as N
from ..operators import filters as P
from ..operators import joins as J

# ---- fixed values (workload parameters of the reference) ------------------------
RADIUS = 50.0          # join radius, EPSG:3857 units
RADIUS2 = 1500.0       # second radius (POIs near cases)
TOP_N = 10
BAND_DAYS = 10         # ± days around a case date (864000 s)
MORNING_HOUR = 8
# ---------------------------------------------------------------------------------


def with_date(points: DataFrame, ms_col: str = "sys_ms") -> DataFrame:
    return points.withColumn("date", TF.ms_to_date_str(ms_col))


def with_geom(df: DataFrame, wkt_col: str = "wkt", geom_col: str = "geom") -> DataFrame:
    return df.withColumn(geom_col, G.geom_from_wkt_col(wkt_col))


# ---- J1: circles around POIs --------------------------------------------------------

def poi_circle_pairs(points: DataFrame, pois: DataFrame, radius: float = RADIUS2, distinct: bool = False, **opts) -> DataFrame:
    """(POI, point) pairs with the point in the POI's circle (inclusive).

    A window is a circle, identified by the POI's coordinates (only geometry
    survives the reference's reader): POIs at one place are one window. Members
    are point coordinates, one row per point record, or (``distinct``) one per
    coordinate in degrees. These are shuffled once and without their projection: by
    themselves where the circles are broadcast, else by the cells of the join.
    """
    if distinct:
        at, win = points.select("lng", "lat").filter("lng IS NOT NULL AND lat IS NOT NULL"), _circles(pois)
        x, y = crs.to_mercator("lng", "lat")
        projected = lambda df: df.withColumn("x", x).withColumn("y", y)
        celled = J.circles_bytes(win) > opts.get("broadcast_bytes", C.BROADCAST_BYTES)
        if celled:
            at = C.with_point_cell(projected(at), "x", "y", float(radius)).select("lng", "lat", "_cx", "_cy")
            at = at.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy")
        return J.distance_join(projected(at.distinct()), win, radius, window_xy=("poi_x", "poi_y"), with_distance=False, celled=celled, **opts)
    pts = points.select("lng", "lat", "x", "y")
    return J.distance_join(pts, _circles(pois), radius, window_xy=("poi_x", "poi_y"), with_distance=False, **opts)


def _circles(pois: DataFrame) -> DataFrame:
    win = pois.select(F.col("lng").alias("poi_lng"), F.col("lat").alias("poi_lat")).distinct()
    x, y = crs.to_mercator("poi_lng", "poi_lat")
    return win.withColumn("poi_x", x).withColumn("poi_y", y)


def places(points: DataFrame) -> DataFrame:
    """The distinct point coordinates."""
    return points.select("lng", "lat", "x", "y").filter("lng IS NOT NULL AND lat IS NOT NULL").distinct()


def poi_circle_counts(points: DataFrame, pois: DataFrame, radius: float = RADIUS2) -> DataFrame:
    """|distinct points| per POI circle, POIs with a match only: distinct coordinates first,
    which then are counted without their pairs."""
    found = N.distance_counts(places(points), _circles(pois), radius, window_xy=("poi_x", "poi_y"))
    return found.select("poi_lng", "poi_lat", "n")


def circle_area(radius: float) -> float:
    return math.pi * radius * radius


# ---- J2-J5: road buffers --------------------------------------------------------------

def road_layer(roads: DataFrame) -> DataFrame:
    """The roads as a written table of numbered features (id, wkt, segments, _wid)."""
    return J.numbered(with_geom(C.dealt(roads)).select("id", "wkt", "geom"), "geom", "roads")


def equal_roads(roads: DataFrame) -> DataFrame:
    """The roads' layer with equal roads (ID and geometry) as one window: id, wkt, copies (how many), segments, _wid."""
    layer = roads.groupBy("id", "wkt").agg(F.count(F.lit(1)).alias("copies"))
    return J.numbered(with_geom(C.dealt(layer)).select("id", "wkt", "copies", "geom"), "geom", "equal-roads")


def road_pairs(points: DataFrame, roads: DataFrame, radius: float = RADIUS, dedupe: bool = False,
               **opts) -> DataFrame:
    """J2 (``dedupe=True``: distinct point coordinates per road) and J3
    (``dedupe=False``: one row per (road, point record)). Roads are features:
    two of one ID stay two in J3, and give their ID's distinct points in J2."""
    if dedupe:  # distinct points and one window an ID: a pair arises once
        layer = road_layer(roads.select("id", "wkt").distinct()).groupBy("id").agg(F.flatten(F.collect_list("_segs")).alias("_segs"))
        layer = C.written(layer.withColumn("_wid", F.monotonically_increasing_id()), "road-ids")
        return J.line_buffer_join(places(points), roads, radius, layer=layer, blocks=["id", "lng", "lat"], **opts).select("id", "lng", "lat")
    layer = equal_roads(roads)  # met once, repeated for every copy
    many = None if layer.filter("copies > 1").isEmpty() else "copies"
    return J.line_buffer_join(points.select("event_id", "x", "y"), roads, radius, layer=layer, blocks=["id", "event_id"], copies=many, **opts).select("id", "event_id")


def road_daily_counts(points: DataFrame, roads: DataFrame, radius: float = RADIUS,
                      start=None, end=None, sort: bool = True, ts_col: str | None = None) -> DataFrame:
    """Points within the r-buffer of each road, counted by (ID, date).
    A point in the buffers of two roads of one ID counts for each; equal roads are one window with a number."""
    pts = with_date(P.time_range(points, start, end, ts_col=ts_col)).select("x", "y", "date")
    found = N.line_buffer_counts(pts, equal_roads(roads), radius, by="date")
    out = found.groupBy("id", "date").agg(F.sum(F.col("n") * F.col("copies")).alias("count"))
    return out.orderBy("date", "id") if sort else out


def road_window_counts(points: DataFrame, roads: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Reports on line-buffer windows (modes 1-6 after J2): id, wkt, n (distinct
    point coordinates) and area of each road's dissolved buffer, roads with a
    match only. Equal roads (ID and geometry) are one window."""
    layer = equal_roads(roads).drop("copies")
    counts = C.written(N.line_buffer_counts(places(points), layer, radius).select("_wid", "n"), "road-counts")
    matched = layer.join(counts.select("_wid"), "_wid", "left_semi")  # areas of roads with a match alone
    return (counts.join(J.line_buffer_areas(matched, radius), "_wid").join(layer.select("_wid", "id", "wkt"), "_wid")
            .select("id", "wkt", "n", "area"))


def road_members(points: DataFrame, roads: DataFrame, radius: float = RADIUS, **opts) -> DataFrame:
    """Mode 2 on line-buffer windows: distinct (id, wkt, lng, lat) rows."""
    layer = equal_roads(roads)  # distinct points and distinct windows: a pair arises once
    pairs = J.line_buffer_join(places(points), roads, radius, layer=layer, blocks=["_wid", "id", "lng", "lat"], **opts)
    return pairs.join(layer.select("_wid", "wkt"), "_wid").select("id", "wkt", "lng", "lat")


def area_window_counts(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Reports on polygon windows (modes 1-6): id, wkt, n (distinct point
    coordinates inside) and area. Equal polygons (ID and geometry) are one window."""
    one = areas.select("id", "wkt").distinct()
    layer = J.numbered(with_geom(C.dealt(one)).withColumn("area", G.area(F.col("geom"))), "geom", "polygons", closed=True)
    return N.polygon_counts(places(points), layer).select("id", "wkt", "n", "area")


def area_members(points: DataFrame, areas: DataFrame, **opts) -> DataFrame:
    """Mode 2 on polygon windows: distinct (id, lng, lat) rows. Distinct points and distinct polygons
    meet once; only where polygons of one ID differ can a point be in several, and is made distinct."""
    layer = J.numbered(with_geom(C.dealt(areas.select("id", "wkt").distinct())).select("id", "geom"), "geom", "polygons", closed=True)
    many = C.written(layer.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "shared-ids")
    pairs = lambda of: J.polygon_join(places(points), of, layer=of, blocks=["id", "lng", "lat"], **opts).select("id", "lng", "lat")
    if many.isEmpty():
        return pairs(layer)
    again = many.withColumnRenamed("id", "_id")
    same = F.col("id").eqNullSafe(F.col("_id"))
    once, shared = (C.written(layer.join(again, same, how), "polygons") for how in ("left_anti", "left_semi"))
    return pairs(once).unionByName(pairs(shared).distinct())


# ---- J6, J7, J12: POIs --------------------------------------------------------------------

def _bbox_points(points: DataFrame, start, end, bbox, ts_col) -> DataFrame:
    pts = P.time_range(points, start, end, whole_days=True, ts_col=ts_col)
    if bbox is not None:
        pts = P.within_bbox(pts, bbox)
    return with_date(pts)


def poi_daily_counts(points: DataFrame, pois: DataFrame, radius: float = RADIUS, start=None, end=None,
                     by_poi: bool = True, bbox=None, ts_col: str | None = None) -> DataFrame:
    """Points (in the bbox if one is given, in the day range) within ``radius`` of a POI
    (inclusive), counted by (OBJECTID, date) or by date."""
    pts = _bbox_points(points, start, end, bbox, ts_col).select("x", "y", "date")
    win = pois.select("objectid", F.col("x").alias("poi_x"), F.col("y").alias("poi_y"))
    found = N.distance_counts(pts, win, radius, by="date", window_xy=("poi_x", "poi_y"))
    out = found.groupBy(*(["objectid", "date"] if by_poi else ["date"])).agg(F.sum("n").alias("join_count"))
    return out.orderBy("date", *(["objectid"] if by_poi else []))


def pois_near_cases_pairs(pois: DataFrame, cases: DataFrame, radius2: float = RADIUS2, **opts) -> DataFrame:
    """(POI, case) pairs within radius2 (inclusive); a POI near n cases gives n rows."""
    p = pois.select("objectid", "x", "y")
    c = cases.select(F.col("date").alias("case_date"), F.col("x").alias("case_x"), F.col("y").alias("case_y"))
    return J.distance_join(p, c, radius2, window_xy=("case_x", "case_y"), with_distance=False, **opts)


def pois_near_cases(pois: DataFrame, cases: DataFrame, radius2: float = RADIUS2, how: str = "left_semi", **opts) -> DataFrame:
    """OBJECTIDs of POIs within radius2 of any case (``left_anti``: of none).

    A semi join: a POI comes once however many cases are near. OBJECTIDs are a
    key of the POIs; where they repeat, so do the rows.
    """
    c = cases.select(F.col("x").alias("case_x"), F.col("y").alias("case_y"))
    return J.distance_join(pois.select("objectid", "x", "y"), c, radius2, window_xy=("case_x", "case_y"), with_distance=False, how=how, **opts).select("objectid")


def points_off_roads(points: DataFrame, roads: DataFrame, radius: float = RADIUS, how: str = "left_anti", **opts) -> DataFrame:
    """Point records in no road's r-buffer (``left_semi``: in that of any)."""
    return J.line_buffer_join(points, roads, radius, layer=road_layer(roads), how=how, **opts)


def points_in_areas(points: DataFrame, areas: DataFrame, how: str = "left_semi", **opts) -> DataFrame:
    """Point records inside some area, each once (``left_anti``: inside none)."""
    return J.polygon_join(points, with_geom(areas).select("id", "geom"), how=how, **opts)


def exposure_counts(points: DataFrame, pois: DataFrame, cases: DataFrame, radius: float = RADIUS,
                    radius2: float = RADIUS2, start=None, end=None, days: int = BAND_DAYS,
                    bbox=None, ts_col: str | None = None, **opts) -> DataFrame:
    """POIs near a case; then points near those POIs within ±days of the
    case date (inclusive), counted by (OBJECTID, point date).

    The time band is part of the equi-key (day buckets of the band width) so
    candidates are cut by space and time before the residual test. The nearby
    POIs are computed once, as a written table.
    """
    band_ms = days * TF.MS_PER_DAY
    near = pois_near_cases_pairs(pois, cases, radius2, **opts)
    day_ms = TF.date_text_to_ms(F.col("case_date"))
    near = near.select("objectid", F.col("x").alias("poi_x"), F.col("y").alias("poi_y"),
                       (day_ms - F.lit(band_ms)).alias("lo_ms"), (day_ms + F.lit(band_ms)).alias("hi_ms"))
    near = C.written(near, "near-cases")
    pts = _bbox_points(points, start, end, bbox, ts_col).select("x", "y", "sys_ms", "date")
    pairs = J.distance_join(pts, near, radius, window_xy=("poi_x", "poi_y"), with_distance=False,
                            band=dict(point_col="sys_ms", lo="lo_ms", hi="hi_ms", bucket=2 * band_ms), **opts)
    out = pairs.groupBy("objectid", "date").agg(F.count(F.lit(1)).alias("join_count"))
    return out.orderBy("date", "objectid")


# ---- J9-J11: polygons ---------------------------------------------------------------------

def labeled_area_counts(points: DataFrame, areas: DataFrame, start=None, end=None,
                        hour: int = MORNING_HOUR, ts_col: str | None = None) -> DataFrame:
    """Points inside labelled areas during hour ``hour``, counted by date.
    A point inside two areas counts twice."""
    pts = with_date(P.hour_is(P.time_range(points, start, end, whole_days=True, ts_col=ts_col), hour)).select("x", "y", "date")
    layer = J.numbered(with_geom(areas).select("id", "geom"), "geom", "areas", closed=True)
    found = N.polygon_counts(pts, layer, by="date")
    return found.groupBy("date").agg(F.sum("n").alias("join_count")).orderBy("date")


def fishnet_daily_counts(points: DataFrame, fishnet: DataFrame, start=None, end=None,
                         drop_boundary: bool = True, ts_col: str | None = None, **opts) -> DataFrame:
    """Points per fishnet polygon per day, one pass instead of a day loop.
    Day bounds are open in the reference, so points exactly at midnight are
    dropped when ``drop_boundary``."""
    pts = P.time_range(points, start, end, whole_days=True, ts_col=ts_col)
    if drop_boundary:
        pts = pts.filter(F.pmod(F.col("sys_ms"), F.lit(TF.MS_PER_DAY)) != F.lit(0))
    pts = with_date(pts).select("x", "y", "date")
    polys = with_geom(fishnet).select("oid", "geom")
    pairs = J.polygon_join(pts, polys, geom_col="geom", **opts)
    return pairs.groupBy("oid", "date").agg(F.count(F.lit(1)).alias("join_count"))


def fishnet_counts(points: DataFrame, fishnet: DataFrame, start=None, end=None, ts_col: str | None = None, **opts) -> DataFrame:
    """Distinct point geometries per fishnet polygon over the whole range."""
    pts = P.time_range(points, start, end, ts_col=ts_col).select("x", "y")
    polys = with_geom(fishnet).select("oid", "geom")
    pairs = J.polygon_join(pts, polys, geom_col="geom", **opts)  # join first: only points in the net are shuffled
    return pairs.groupBy("oid").agg(F.count_distinct("x", "y").alias("n_points"))


def regular_fishnet_counts(points: DataFrame, x0: float, y0: float, cell: float, nx: int, ny: int,
                           start=None, end=None, ts_col: str | None = None) -> DataFrame:
    """J11 for an axis-aligned regular fishnet: closed-form cell, no join."""
    pts = P.time_range(points, start, end, ts_col=ts_col).select("x", "y")
    return (J.regular_grid_join(pts, x0=x0, y0=y0, cell=cell, nx=nx, ny=ny)
            .groupBy("oid").agg(F.count_distinct("x", "y").alias("n_points")))


def to_utm_points(points: DataFrame, zone: int) -> DataFrame:
    """The points with x, y in UTM metres of a northern zone."""
    e, n = crs.to_utm("lng", "lat", zone)
    return points.withColumns({"x": e, "y": n})
