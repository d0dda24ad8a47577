"""Coordinate conversions as Spark column expressions.

All conversions are closed-form column arithmetic, so they compile into
whole-stage codegen. The datum shift (C4) is an iterative fixed point; it is
written as a bounded ``aggregate`` fold over a struct so the delta is computed
once per step instead of being duplicated by nested expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must match the published definitions) -------------------
# Web Mercator (EPSG:3857) sphere radius and half circumference.
MERC_R = 6378137.0
MERC_HALF = 20037508.342789244
# WGS-84 ellipsoid for UTM.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
# GCJ-02 offset: Krasovsky semi-major axis and eccentricity squared used by the
# published GCJ-02 obfuscation, and the stop rule of the inverse iteration.
GCJ_AXIS = 6378245.0
GCJ_EE = 0.00669342162296594323
GCJ_TOLERANCE = 1e-7
GCJ_MAX_STEPS = 6
# The published GCJ-02 offset in metres, for x = lng - 105 and y = lat - 35: a
# polynomial (1, x, y, x*x, y*y, x*y, sqrt|x|) plus 2/3 of harmonics
# (amplitude, variable, multiplier, divisor) = amplitude * sin(variable * multiplier / divisor * pi).
GCJ_ORIGIN = (105.0, 35.0)
GCJ_NORTH = ((-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2),
             ((20.0, "x", 6.0, 1.0), (20.0, "x", 2.0, 1.0), (20.0, "y", 1.0, 1.0), (40.0, "y", 1.0, 3.0),
              (160.0, "y", 1.0, 12.0), (320.0, "y", 1.0, 30.0)))
GCJ_EAST = ((300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1),
            ((20.0, "x", 6.0, 1.0), (20.0, "x", 2.0, 1.0), (20.0, "x", 1.0, 1.0), (40.0, "x", 1.0, 3.0),
             (150.0, "x", 1.0, 12.0), (300.0, "x", 1.0, 30.0)))
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def point_cols(lng, lat, scale: int = 14):
    """Decimal-normalised double coordinates from text or numbers.

    Dirty text (empty, non-numeric) becomes null instead of failing the job.
    """
    dec = f"decimal(24,{scale})"
    return (_c(lng).try_cast(dec).cast("double"), _c(lat).try_cast(dec).cast("double"))


def mercator_x(lng) -> Column:
    """EPSG:4326 longitude → EPSG:3857 x."""
    return _c(lng) * F.lit(MERC_HALF) / F.lit(180.0)


def mercator_y(lat) -> Column:
    """EPSG:4326 latitude → EPSG:3857 y."""
    return F.log(F.tan((F.lit(90.0) + _c(lat)) * F.lit(math.pi) / F.lit(360.0))) * F.lit(MERC_R)


def to_mercator(lng, lat):
    return mercator_x(lng), mercator_y(lat)


def from_mercator(x, y):
    """EPSG:3857 → EPSG:4326 (inverse of C2)."""
    lng = _c(x) / F.lit(MERC_HALF) * F.lit(180.0)
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(MERC_R))) - F.lit(math.pi / 2))
    return lng, lat


def mercator_to_lonlat_literal(x: float, y: float):
    """Driver-side inverse for literal bounds."""
    lng = x / MERC_HALF * 180.0
    lat = math.degrees(2.0 * math.atan(math.exp(y / MERC_R)) - math.pi / 2)
    return lng, lat


def lonlat_to_mercator_literal(lng: float, lat: float):
    """Driver-side C2 for literal bounds (constant folding done once)."""
    return (lng * MERC_HALF / 180.0,
            math.log(math.tan((90.0 + lat) * math.pi / 360.0)) * MERC_R)


def to_utm(lng, lat, zone: int = 50, north: bool = True):
    """EPSG:4326 → UTM (zone 50N = EPSG:32650 by default).

    Transverse Mercator series (Snyder, USGS PP 1395, eq. 8-9 .. 8-10);
    sub-millimetre inside a zone.
    """
    a, f = WGS84_A, WGS84_F
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e4, e6 = e2 * e2, e2 * e2 * e2
    lon0 = math.radians(zone * 6 - 183)
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lng))
    sin_p, cos_p, tan_p = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * sin_p * sin_p)
    t = tan_p * tan_p
    c = F.lit(ep2) * cos_p * cos_p
    aa = cos_p * (lam - F.lit(lon0))
    m = F.lit(a) * (F.lit(1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                    - F.lit(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(F.lit(2.0) * phi)
                    + F.lit(15 * e4 / 256 + 45 * e6 / 1024) * F.sin(F.lit(4.0) * phi)
                    - F.lit(35 * e6 / 3072) * F.sin(F.lit(6.0) * phi))
    a2 = aa * aa
    a3 = a2 * aa
    a4 = a2 * a2
    a5 = a4 * aa
    a6 = a3 * a3
    x = F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0) * n * (
        aa + (F.lit(1.0) - t + c) * a3 / F.lit(6.0)
        + (F.lit(5.0) - F.lit(18.0) * t + t * t + F.lit(72.0) * c - F.lit(58.0 * ep2)) * a5 / F.lit(120.0))
    y = F.lit(UTM_K0) * (m + n * tan_p * (
        a2 / F.lit(2.0)
        + (F.lit(5.0) - t + F.lit(9.0) * c + F.lit(4.0) * c * c) * a4 / F.lit(24.0)
        + (F.lit(61.0) - F.lit(58.0) * t + t * t + F.lit(600.0) * c - F.lit(330.0 * ep2)) * a6 / F.lit(720.0)))
    if not north:
        y = y + F.lit(UTM_FALSE_NORTHING_SOUTH)
    return x, y


def utm_sql(lng: str, lat: str, zone: str, south: str) -> str:
    """C3 as SQL text: ``struct<x, y>`` in the UTM zone given by SQL fragments for its
    number and whether it is a southern one."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    e4, e6 = e2 * e2, e2 * e2 * e2
    m = (f"{WGS84_A!r}D * ({1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256!r}D * q.phi - {3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024!r}D * sin(2D * q.phi) "
         f"+ {15 * e4 / 256 + 45 * e6 / 1024!r}D * sin(4D * q.phi) - {35 * e6 / 3072!r}D * sin(6D * q.phi))")
    n = f"{WGS84_A!r}D / sqrt(1D - {e2!r}D * sin(q.phi) * sin(q.phi))"
    east = (f"{UTM_FALSE_EASTING!r}D + {UTM_K0!r}D * w.n * (w.a + (1D - w.t + w.c) * pow(w.a, 3) / 6D "
            f"+ (5D - 18D * w.t + w.t * w.t + 72D * w.c - {58.0 * ep2!r}D) * pow(w.a, 5) / 120D)")
    north = (f"{UTM_K0!r}D * (w.m + w.n * sqrt(w.t) * sign(w.phi) * (pow(w.a, 2) / 2D + (5D - w.t + 9D * w.c + 4D * w.c * w.c) * pow(w.a, 4) / 24D "
             f"+ (61D - 58D * w.t + w.t * w.t + 600D * w.c - {330.0 * ep2!r}D) * pow(w.a, 6) / 720D)) + IF({south}, {UTM_FALSE_NORTHING_SOUTH!r}D, 0D)")
    inner = (f"named_struct('phi', q.phi, 'n', {n}, 't', tan(q.phi) * tan(q.phi), 'c', {ep2!r}D * cos(q.phi) * cos(q.phi), "
             f"'a', cos(q.phi) * (q.lam - radians({zone} * 6D - 183D)), 'm', {m})")
    return (f"element_at(transform(transform(array(named_struct('phi', radians({lat}), 'lam', radians({lng}))), q -> {inner}), "
            f"w -> named_struct('x', {east}, 'y', {north})), 1)")


# ---- GCJ-02 --------------------------------------------------------------------

def _offset_metres(series, x, y, m):
    """A GCJ-02 offset component from its table; ``m`` has sin, sqrt and abs for
    the kind of values (columns or arrays)."""
    poly, harmonics = series
    monomials = (None, x, y, x * x, y * y, x * y, m.sqrt(m.abs(x)))
    total = poly[0]
    for c, v in zip(poly[1:], monomials[1:]):
        if c:
            total = v * c + total
    waves = sum(m.sin((x if var == "x" else y) * (mul / div * math.pi)) * amp for amp, var, mul, div in harmonics)
    return total + waves * (2.0 / 3.0)


def _offset_degrees(lng, lat, m):
    """(dlng, dlat) in degrees: metres over the ellipsoid's radii of curvature,
    along the parallel and along the meridian."""
    x, y = lng - GCJ_ORIGIN[0], lat - GCJ_ORIGIN[1]
    phi = lat * (math.pi / 180.0)
    w2 = m.sin(phi) * m.sin(phi) * -GCJ_EE + 1.0
    normal = m.sqrt(w2) ** -1 * GCJ_AXIS
    meridian = normal / w2 * (1 - GCJ_EE)
    to_degrees = 180.0 / math.pi
    return (_offset_metres(GCJ_EAST, x, y, m) / (normal * m.cos(phi)) * to_degrees,
            _offset_metres(GCJ_NORTH, x, y, m) / meridian * to_degrees)


def gcj_delta(lng, lat) -> Column:
    """GCJ-02 offset (dlng, dlat) in degrees at a WGS-84 position.

    Returns ``struct<dlng:double, dlat:double>``; GCJ = WGS + delta.
    """
    east, north = _offset_degrees(_c(lng), _c(lat), F)
    return F.struct(east.alias("dlng"), north.alias("dlat"))


def wgs_to_gcj(lng, lat) -> Column:
    """Forward datum shift WGS-84 → GCJ-02 as ``struct<lng, lat>``."""
    d = gcj_delta(lng, lat)
    return F.struct((_c(lng) + d["dlng"]).alias("lng"), (_c(lat) + d["dlat"]).alias("lat"))


def gcj_to_wgs(lng, lat) -> Column:
    """C4: GCJ-02 → WGS-84 by the fixed point w ← g − Δ(w).

    Stops when both steps are ≤ 1e-7 (the first step is not tested: its
    "step" is the distance from the origin) or after six steps. Returns
    ``struct<lng:double, lat:double>``.
    """
    g_lng, g_lat = _c(lng).cast("double"), _c(lat).cast("double")
    init = F.struct(g_lng.alias("lng"), g_lat.alias("lat"), F.lit(False).alias("done"))

    def step(acc, i):
        d = gcj_delta(acc["lng"], acc["lat"])
        n_lng = g_lng - d["dlng"]
        n_lat = g_lat - d["dlat"]
        first = i == F.lit(0)
        step_lng = F.when(first, F.abs(acc["lng"])).otherwise(F.abs(n_lng - acc["lng"]))
        step_lat = F.when(first, F.abs(acc["lat"])).otherwise(F.abs(n_lat - acc["lat"]))
        converged = (step_lng <= F.lit(GCJ_TOLERANCE)) & (step_lat <= F.lit(GCJ_TOLERANCE))
        return F.when(acc["done"], acc).otherwise(
            F.struct(n_lng.alias("lng"), n_lat.alias("lat"), converged.alias("done")))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(GCJ_MAX_STEPS - 1)), init, step)
    return F.when(g_lng.isNull() | g_lat.isNull(), F.lit(None)).otherwise(
        F.struct(out["lng"].alias("lng"), out["lat"].alias("lat")))


# ---- vectorised datum shift (Arrow batches) ------------------------------------------

def gcj_to_wgs_batch(g_lng, g_lat):
    """C4 on numpy arrays (same iteration and stop rule as ``gcj_to_wgs``)."""
    import numpy as np
    g_lng = np.asarray(g_lng, dtype="float64")
    g_lat = np.asarray(g_lat, dtype="float64")
    w_lng, w_lat = g_lng.copy(), g_lat.copy()
    done = np.zeros(len(g_lng), dtype=bool)
    for i in range(GCJ_MAX_STEPS):
        d_lng, d_lat = _offset_degrees(w_lng, w_lat, np)
        n_lng, n_lat = g_lng - d_lng, g_lat - d_lat
        if i == 0:
            conv = (np.abs(w_lng) <= GCJ_TOLERANCE) & (np.abs(w_lat) <= GCJ_TOLERANCE)
        else:
            conv = (np.abs(n_lng - w_lng) <= GCJ_TOLERANCE) & (np.abs(n_lat - w_lat) <= GCJ_TOLERANCE)
        w_lng = np.where(done, w_lng, n_lng)
        w_lat = np.where(done, w_lat, n_lat)
        done = done | conv
        if done.all():
            break
    return w_lng, w_lat


def gcj_to_wgs_udf():
    """C4 as an Arrow-batched pandas UDF returning ``struct<lng, lat>``: the
    iteration runs as numpy over whole batches (no per-row Python). Both are
    null where one coordinate is."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def _gcj(a, b):
        x, y = gcj_to_wgs_batch(a.to_numpy(dtype="float64", na_value=float("nan")),
                                b.to_numpy(dtype="float64", na_value=float("nan")))
        none = (a.isna() | b.isna()).to_numpy()
        return pd.DataFrame({"lng": pd.Series(x).mask(none), "lat": pd.Series(y).mask(none)})

    # real annotation objects (this module uses postponed annotations)
    _gcj.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return pandas_udf(_gcj, "lng double, lat double")


def gcj_to_wgs_arrow(lng, lat) -> Column:
    """C4 of two columns by ``gcj_to_wgs_udf``."""
    return gcj_to_wgs_udf()(_c(lng).cast("double"), _c(lat).cast("double"))
