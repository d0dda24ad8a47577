"""SQL functions: the column functions made callable from SQL.

Closed-form functions are registered as Spark SQL functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expr>``) from the same SQL text that
the operators use; Catalyst inlines them, so a SQL query using them plans like
the DataFrame version. A geometry in SQL is a struct of kind, parts, radius
(0 but for buffers) and edges (of its rings, none for a point). All functions give null for a null argument. The GCJ-02
inverse (an iteration) is an Arrow-batched pandas UDF, ``gcj_to_wgs``, which returns
both coordinates; ``trans_lon`` and ``trans_lat`` are its fields, so a query with both
runs the iteration once. ``cells_of(g, reach, size)`` is a table function: the grid
cells that a geometry's box, widened by ``reach``, touches, for lateral use.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from . import geom as G
from .crs import MERC_HALF, MERC_R, gcj_to_wgs_udf, utm_sql
from .geohash import BASE32
from .tiles import EQUATOR


def _geohash_expr(precision: int = 8) -> str:
    total = 5 * precision
    n_lng, n_lat = (total + 1) // 2, total // 2

    def q(v, lo, span, n):
        return (f"CAST(least(greatest(ceil(({v} - ({lo})) / {span} * {float(1 << n)}) - 1, 0), "
                f"{(1 << n) - 1}) AS BIGINT)")
    qx, qy = q("lng", -180.0, 360.0, n_lng), q("lat", -90.0, 180.0, n_lat)
    chars = []
    for i in range(precision):
        terms = []
        for b in range(5):
            j = 5 * i + b
            src, k, n = (qx, j // 2, n_lng) if j % 2 == 0 else (qy, j // 2, n_lat)
            terms.append(f"shiftleft(shiftright({src}, {n - 1 - k}) & 1, {4 - b})")
        chars.append(f"substr('{BASE32}', CAST({' + '.join(terms)} AS INT) + 1, 1)")
    return "IF(lng IS NULL OR lat IS NULL, NULL, concat(" + ", ".join(chars) + "))"


#: edges: the segments of all rings with their vectors, made once with the geometry and read by every predicate.
_EDGES = "ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, dx: DOUBLE, dy: DOUBLE, l2: DOUBLE>>"
GEOMETRY = f"STRUCT<kind: STRING, parts: ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>, radius: DOUBLE, edges: {_EDGES}>"


def _geometry(kind: str, parts: str, radius: str = "0D", edges: str = f"CAST(array() AS {_EDGES})") -> str:
    return f"named_struct('kind', {kind}, 'parts', {parts}, 'radius', {radius}, 'edges', {edges})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value`` once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_X, _Y = "{0}.parts[0][0][0].x", "{0}.parts[0][0][0].y"
_XY = [f.format(p) for p in ("a", "b") for f in (_X, _Y)]
_VECTORS = ("transform(" + G.segments_sql("n") + ", s -> named_struct('x1', s.x1, 'y1', s.y1, 'x2', s.x2, 'y2', s.y2, 'dx', s.x2 - s.x1, 'dy', s.y2 - s.y1, "
            "'l2', IF(s.x1 = s.x2 AND s.y1 = s.y2, 1D, (s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))))")


def _edged(kind: str, parts: str, radius: str = "0D") -> str:
    """A geometry with its edges."""
    return _let(f"named_struct('kind', {kind}, 'parts', {parts}, 'radius', {radius})", "n", _geometry("n.kind", "n.parts", "n.radius", _VECTORS))


# an envelope's edges one by one, without lambdas: Spark folds those of literals
_CORNERS = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")]


def _edge(a: tuple[str, str], b: tuple[str, str]) -> str:
    dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    return (f"named_struct('x1', {a[0]}, 'y1', {a[1]}, 'x2', {b[0]}, 'y2', {b[1]}, 'dx', {dx}, 'dy', {dy}, "
            f"'l2', IF({a[0]} = {b[0]} AND {a[1]} = {b[1]}, 1D, {dx} * {dx} + {dy} * {dy}))")


_PX, _PY = _X.format("p"), _Y.format("p")
# the point's coordinates are bound once: an argument is inlined wherever its name stands, and inside a
# lambda it would be built anew for every edge
_POINT = f"named_struct('x', {_PX}, 'y', {_PY}, 'e', g.edges)"
# squared distances in steps, each of which is evaluated once (the same arithmetic as geom.vector_d2_sql)
_D2 = ("transform(transform(transform(q.e, v -> named_struct('v', v, 't', greatest(0.0D, least(1.0D, ((q.x - v.x1) * v.dx + (q.y - v.y1) * v.dy) / v.l2)))), "
       "u -> named_struct('x', q.x - (u.v.x1 + u.t * u.v.dx), 'y', q.y - (u.v.y1 + u.t * u.v.dy))), w -> w.x * w.x + w.y * w.y)")
_WITHIN = (f"CASE WHEN g.radius > 0 AND g.kind = 'POINT' THEN sqrt(pow({_PX} - g.parts[0][0][0].x, 2) + pow({_PY} - g.parts[0][0][0].y, 2)) < g.radius "
           f"WHEN g.radius > 0 THEN {_let(_POINT, 'q', f'array_min({_D2})')} < g.radius * g.radius "
           f"ELSE {_let(_POINT, 'q', G.pip_sql('q.x', 'q.y', 'q.e'))} END")
_BOX = "named_struct('x0', array_min(transform({0}, v -> v.x)), 'y0', array_min(transform({0}, v -> v.y)), 'x1', array_max(transform({0}, v -> v.x)), 'y1', array_max(transform({0}, v -> v.y)))"
# the envelope covers all vertices, and some vertex or middle of a segment lies inside it
_COVERS = _let(_BOX.format("flatten(flatten(g.parts))"), "b", "forall(flatten(flatten(p.parts)), v -> v.x >= b.x0 AND v.x <= b.x1 AND v.y >= b.y0 AND v.y <= b.y1) AND ("
               "exists(flatten(flatten(p.parts)), v -> v.x > b.x0 AND v.x < b.x1 AND v.y > b.y0 AND v.y < b.y1) OR "
               f"exists({G.segments_sql('p')}, s -> (s.x1 + s.x2) / 2 > b.x0 AND (s.x1 + s.x2) / 2 < b.x1 AND (s.y1 + s.y2) / 2 > b.y0 AND (s.y1 + s.y2) / 2 < b.y1))")
_RING = "abs(aggregate(" + "IF(size({r}) >= 2, sequence(0, size({r}) - 2), array())" + ", 0D, (a, i) -> a + (get({r}, i).x * get({r}, i + 1).y - get({r}, i + 1).x * get({r}, i).y))) / 2"
_MERCATOR = ("transform(g.parts, p -> transform(p, r -> transform(r, v -> named_struct("
             f"'x', v.x * {MERC_HALF!r}D / 180.0D, 'y', ln(tan((90.0D + v.y) * {math.pi!r}D / 360.0D)) * {MERC_R!r}D))))")
_LONLAT = ("transform(g.parts, p -> transform(p, r -> transform(r, v -> named_struct("
           f"'x', v.x / {MERC_HALF!r}D * 180D, 'y', degrees(2D * atan(exp(v.y / {MERC_R!r}D)) - {math.pi / 2!r}D)))))")
_UTM = ("transform(g.parts, p -> transform(p, r -> transform(r, v -> "
        + utm_sql("v.x", "v.y", "CAST(substr(target, 9) AS INT)", "substr(target, 8, 1) = '7'") + ")))")
_UTM_CODE = "'(?i)^epsg:32[67](0[1-9]|[1-5][0-9]|60)$'"

FUNCTIONS = {
    "st_point": ("x DOUBLE, y DOUBLE", GEOMETRY, f"IF(x IS NULL OR y IS NULL, NULL, {_geometry(chr(39) + 'POINT' + chr(39), 'array(array(array(named_struct(' + chr(39) + 'x' + chr(39) + ', x, ' + chr(39) + 'y' + chr(39) + ', y))))')})"),
    "st_geomfromwkt": ("wkt STRING", GEOMETRY, _let(G.wkt_sql("wkt"), "q", f"IF(q IS NULL, NULL, {_edged('q.kind', 'q.parts')})")),
    "st_geomfromtext": ("wkt STRING", GEOMETRY, _let(G.wkt_sql("wkt"), "q", f"IF(q IS NULL, NULL, {_edged('q.kind', 'q.parts')})")),
    "st_polygonfromenvelope": ("minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE", GEOMETRY,
                               "IF(minx IS NULL OR miny IS NULL OR maxx IS NULL OR maxy IS NULL, NULL, " + _geometry("'POLYGON'", "array(array(array("
                               + ", ".join(f"named_struct('x', {a}, 'y', {b})" for a, b in _CORNERS) + ")))", edges="array(" + ", ".join(map(_edge, _CORNERS, _CORNERS[1:])) + ")") + ")"),
    "st_transform": (f"g {GEOMETRY}, source STRING, target STRING", GEOMETRY,
                     f"CASE WHEN g IS NULL OR source IS NULL OR target IS NULL THEN NULL WHEN lower(source) = lower(target) THEN g "
                     f"WHEN lower(source) = 'epsg:4326' AND lower(target) = 'epsg:3857' THEN {_edged('g.kind', _MERCATOR, 'g.radius')} "
                     f"WHEN lower(source) = 'epsg:3857' AND lower(target) = 'epsg:4326' THEN {_edged('g.kind', _LONLAT, 'g.radius')} "
                     f"WHEN lower(source) = 'epsg:4326' AND target RLIKE {_UTM_CODE} THEN {_edged('g.kind', _UTM, 'g.radius')} "
                     "ELSE raise_error('st_transform: from epsg:4326 to epsg:3857, epsg:326zz and epsg:327zz (UTM), and from epsg:3857 to epsg:4326') END"),
    "st_buffer": (f"g {GEOMETRY}, r DOUBLE", GEOMETRY, f"IF(g IS NULL OR r IS NULL, NULL, {_geometry('g.kind', 'g.parts', 'g.radius + r', 'g.edges')})"),
    "st_distance": (f"a {GEOMETRY}, b {GEOMETRY}", "DOUBLE", f"sqrt(({_XY[0]} - {_XY[2]}) * ({_XY[0]} - {_XY[2]}) + ({_XY[1]} - {_XY[3]}) * ({_XY[1]} - {_XY[3]}))"),
    "st_within": (f"p {GEOMETRY}, g {GEOMETRY}", "BOOLEAN", f"IF(p IS NULL OR g IS NULL, NULL, {_WITHIN})"),
    "st_contains": (f"g {GEOMETRY}, p {GEOMETRY}", "BOOLEAN", f"CASE WHEN p IS NULL OR g IS NULL THEN NULL WHEN p.kind = 'POINT' THEN {_WITHIN} ELSE {_COVERS} END"),
    "st_area": (f"g {GEOMETRY}", "DOUBLE", f"CASE WHEN g IS NULL THEN NULL WHEN g.kind = 'POINT' THEN {math.pi!r}D * g.radius * g.radius WHEN g.kind NOT LIKE '%POLYGON' THEN 0D ELSE "
                "aggregate(transform(g.parts, p -> aggregate(slice(p, 2, greatest(size(p) - 1, 0)), " + _RING.format(r="p[0]") + ", (a, r) -> a - " + _RING.format(r="r").replace("(a, i) -> a +", "(c, i) -> c +") + ")), 0D, (a, v) -> a + v) END"),
    **{f"st_{c}{m}": (f"g {GEOMETRY}", "DOUBLE", f"array_{m}(transform(flatten(flatten(g.parts)), v -> v.{c})) {sign} g.radius")
       for c in "xy" for m, sign in (("min", "-"), ("max", "+"))},
    "st_mercator_x": ("lng DOUBLE", "DOUBLE", f"lng * {MERC_HALF!r} / 180.0"),
    "st_mercator_y": ("lat DOUBLE", "DOUBLE", f"ln(tan((90.0 + lat) * {math.pi!r} / 360.0)) * {MERC_R!r}"),
    "st_distance_xy": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE",
                       "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"),
    "st_in_box": ("x DOUBLE, y DOUBLE, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE", "BOOLEAN",
                  "x > minx AND x < maxx AND y > miny AND y < maxy"),
    "ms_date": ("ms BIGINT", "STRING", "CAST(date_from_unix_date(CAST(floor(ms / 86400000) AS INT)) AS STRING)"),
    "ms_hour": ("ms BIGINT", "INT", "CAST(floor(pmod(ms, 86400000) / 3600000) AS INT)"),
    "tile_x": ("x DOUBLE, z INT", "INT", f"CAST((x + {EQUATOR / 2!r}) / {EQUATOR!r} * pow(2, z) AS INT)"),
    "tile_y": ("y DOUBLE, z INT", "INT", f"CAST(({EQUATOR / 2!r} - y) / {EQUATOR!r} * pow(2, z) AS INT)"),
    "geohash8": ("lng DOUBLE, lat DOUBLE", "STRING", _geohash_expr(8)),
}


_AXIS = "sequence(CAST(floor((array_min(transform(flatten(flatten(g.parts)), v -> v.{0})) - reach) / size) AS BIGINT), CAST(floor((array_max(transform(flatten(flatten(g.parts)), v -> v.{0})) + reach) / size) AS BIGINT))"

#: Table functions: parameters, columns, query.
TABLE_FUNCTIONS = {
    "cells_of": (f"g {GEOMETRY}, reach DOUBLE, size DOUBLE", "cx BIGINT, cy BIGINT",
                 f"SELECT c.cx, c.cy FROM (SELECT explode(flatten(transform({_AXIS.format('x')}, x -> transform({_AXIS.format('y')}, y -> named_struct('cx', x, 'cy', y))))) AS c)"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Register every SQL function in this session; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    for name, (args, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udf.register("gcj_to_wgs", gcj_to_wgs_udf())
    for name, field in (("trans_lon", "lng"), ("trans_lat", "lat")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(lng DOUBLE, lat DOUBLE) RETURNS DOUBLE RETURN gcj_to_wgs(lng, lat).{field}")
    return [*FUNCTIONS, *TABLE_FUNCTIONS, "gcj_to_wgs", "trans_lon", "trans_lat"]
