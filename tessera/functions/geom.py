"""Geometry held in ordinary Spark columns.

A geometry is ``struct<kind:string, parts:array<array<array<struct<x,y>>>>>``
(part → ring → vertex). Points are simply two double columns. WKT is parsed
with ``regexp``/``split``/``transform`` in one pass: no UDF.

Predicates on full geometries use higher-order functions (interpreted, not
codegen), so operators apply them only to candidate pairs that survived a cell
equi-join and a bounding-box test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)
GEOMETRY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(RING))),
])
SEGMENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: Spark inlines a column into every place that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- WKT ---------------------------------------------------------------------------

def _vertex(txt: Column) -> Column:
    nums = F.split(F.trim(txt), r"\s+")
    return F.struct(F.get(nums, F.lit(0)).try_cast("double").alias("x"),
                    F.get(nums, F.lit(1)).try_cast("double").alias("y"))


def geom_from_wkt(wkt) -> Column:
    """G1: WKT text → geometry struct (POINT, LINESTRING, POLYGON, MULTI*).

    Z/M ordinates are dropped. ``... EMPTY`` gives an empty part list; text
    that is not WKT, or has a vertex without two numbers, gives null.
    """
    w = F.trim(_c(wkt))
    kind = F.upper(F.regexp_extract(w, r"^([A-Za-z]+)", 1))
    body = F.regexp_replace(w, r"^[A-Za-z]+\s*(ZM|Z|M)?\s*", "")
    inner = F.regexp_replace(F.regexp_replace(body, r"^[\s(]+", ""), r"[\s)]+$", "")
    part_txt = F.split(inner, r"\)\s*\)\s*,\s*\(\s*\(")
    parts = F.transform(part_txt, lambda p: F.transform(
        F.split(p, r"\)\s*,\s*\("),
        lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), _vertex)))
    # a MULTILINESTRING / MULTIPOINT lists its members as rings of one part
    parts = F.when(kind.isin("MULTILINESTRING", "MULTIPOINT"),
                   F.transform(parts.getItem(0), lambda r: F.array(r))).otherwise(parts)
    empty = F.upper(body).startswith("EMPTY")
    valid = kind.isin("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
    parts = F.when(empty, F.array().cast(GEOMETRY["parts"].dataType)).otherwise(parts)
    whole = F.forall(F.flatten(F.flatten(parts)), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return F.when(valid & whole, F.struct(kind.alias("kind"), parts.alias("parts")))


def _fmt(v: Column, digits: int) -> Column:
    txt = v.cast(f"decimal(38,{digits})").cast("string")
    txt = F.regexp_replace(txt, r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(txt, r"\.$", "")


def geom_to_wkt(geom, digits: int = 9) -> Column:
    """Geometry struct → WKT text (plain decimals, ``digits`` places)."""
    g = _c(geom)

    def ring_txt(r):
        return F.array_join(F.transform(r, lambda v: F.concat(_fmt(v["x"], digits), F.lit(" "),
                                                               _fmt(v["y"], digits))), ", ")

    def part_txt(p):
        return F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: F.concat(F.lit("("), ring_txt(r), F.lit(")"))), ", "), F.lit(")"))

    kind = g["kind"]
    first_ring = g["parts"].getItem(0).getItem(0)
    return (F.when(F.size(g["parts"]) == 0, F.concat(kind, F.lit(" EMPTY")))
            .when(kind.isin("POINT", "LINESTRING"), F.concat(kind, F.lit(" ("), ring_txt(first_ring), F.lit(")")))
            .when(kind == "POLYGON", F.concat(kind, F.lit(" "), part_txt(g["parts"].getItem(0))))
            .when(kind.isin("MULTILINESTRING", "MULTIPOINT"), F.concat(kind, F.lit(" ("), F.array_join(
                F.transform(g["parts"], lambda p: F.concat(F.lit("("), ring_txt(p.getItem(0)), F.lit(")"))), ", "), F.lit(")")))
            .otherwise(F.concat(kind, F.lit(" ("), F.array_join(F.transform(g["parts"], part_txt), ", "), F.lit(")"))))


def point_wkt(x, y, digits: int = 9) -> Column:
    return F.concat(F.lit("POINT ("), _fmt(_c(x), digits), F.lit(" "), _fmt(_c(y), digits), F.lit(")"))


def envelope_polygon(minx, miny, maxx, maxy) -> Column:
    """Closed rectangle polygon from four numbers."""
    ring = F.array(*(F.struct((F.lit(a) if not isinstance(a, Column) else a).cast("double").alias("x"),
                              (F.lit(b) if not isinstance(b, Column) else b).cast("double").alias("y"))
                     for a, b in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))))
    return F.struct(F.lit("POLYGON").alias("kind"), F.array(F.array(ring)).alias("parts"))


# ---- structure -------------------------------------------------------------------

def rings(geom) -> Column:
    return F.flatten(_c(geom)["parts"])


def vertices(geom) -> Column:
    return F.flatten(rings(geom))


def bbox(geom) -> Column:
    """``struct<minx, miny, maxx, maxy>`` of a geometry (A13 for one row)."""
    vs = vertices(geom)
    xs = F.transform(vs, lambda v: v["x"])
    ys = F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _ring_segments(r: Column) -> Column:
    n = F.size(r)
    idx = F.when(n >= 2, F.sequence(F.lit(0), n - F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(
        F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"),
        F.get(r, i + 1)["x"].alias("x2"), F.get(r, i + 1)["y"].alias("y2")))


def segments(geom) -> Column:
    """All segments of all rings as ``array<struct<x1,y1,x2,y2>>``."""
    return F.flatten(F.transform(rings(geom), _ring_segments))


# ---- measures and predicates -----------------------------------------------------

def planar_distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance of two points in the plane."""
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px, py, seg) -> Column:
    """Distance from a point to a segment ``struct<x1,y1,x2,y2>``."""
    px, py, s = _c(px), _c(py), _c(seg)
    dx = s["x2"] - s["x1"]
    dy = s["y2"] - s["y1"]
    l2 = dx * dx + dy * dy
    t = F.when(l2 == F.lit(0.0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["x1"]) * dx + (py - s["y1"]) * dy) / l2)))
    qx = s["x1"] + t * dx
    qy = s["y1"] + t * dy
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


def point_in_segments(px, py, segs, boundary: bool = False) -> Column:
    """Even-odd test against a precomputed ``array<struct<x1,y1,x2,y2>>`` of
    all ring edges (see ``point_in_polygon``)."""
    px, py = _c(px), _c(py)
    init = F.struct(F.lit(0).alias("c"), F.lit(False).alias("b"))

    def per_segment(acc, s):
        x1, y1, x2, y2 = s["x1"], s["y1"], s["x2"], s["y2"]
        crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        on_edge = (((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)) == F.lit(0.0)) \
            & (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2)) \
            & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2))
        return F.struct((acc["c"] + F.when(crosses, 1).otherwise(0)).alias("c"),
                        (acc["b"] | on_edge).alias("b"))

    r = F.aggregate(_c(segs), init, per_segment)
    inside = F.pmod(r["c"], F.lit(2)) == F.lit(1)
    return (inside | r["b"]) if boundary else (inside & ~r["b"])


def point_in_polygon(px, py, geom, boundary: bool = False) -> Column:
    """Even-odd test of a point against all rings of a (multi)polygon.

    ``boundary=False`` is ``ST_Within`` (interior only): a point on an edge or
    vertex is outside. ``boundary=True`` counts the boundary as inside
    (``ST_Intersects`` for a point). Holes are rings, so they flip parity.
    """
    return point_in_segments(px, py, segments(geom), boundary)


def ring_area(r: Column) -> Column:
    """Signed shoelace area of one closed ring."""
    return F.aggregate(_ring_segments(r), F.lit(0.0),
                       lambda acc, s: acc + (s["x1"] * s["y2"] - s["x2"] * s["y1"])) / F.lit(2.0)


def area(geom) -> Column:
    """Area of a (multi)polygon: |shell| − Σ|holes| per part; 0 for lines/points."""
    g = _c(geom)
    per_part = F.transform(g["parts"], lambda p: F.aggregate(
        F.transform(p, lambda r: F.abs(ring_area(r))), F.lit(0.0),
        lambda acc, a: F.when(acc == F.lit(0.0), a).otherwise(acc - a)))
    poly = F.aggregate(per_part, F.lit(0.0), lambda acc, a: acc + a)
    return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), poly).otherwise(F.lit(0.0))


def circle_area(radius) -> Column:
    return F.lit(math.pi) * _c(radius) * _c(radius) if isinstance(radius, (str, Column)) \
        else F.lit(math.pi * radius * radius)


def envelope_contains(geom, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """The rectangle contains the geometry (JTS rule: every vertex covered,
    and not all of it on the rectangle boundary)."""
    b = bbox(geom)
    covered = (b["minx"] >= F.lit(minx)) & (b["maxx"] <= F.lit(maxx)) \
        & (b["miny"] >= F.lit(miny)) & (b["maxy"] <= F.lit(maxy))
    interior = F.exists(vertices(geom), lambda v: (v["x"] > F.lit(minx)) & (v["x"] < F.lit(maxx))
                        & (v["y"] > F.lit(miny)) & (v["y"] < F.lit(maxy)))
    # a segment may run through the interior with both ends on the boundary
    through = F.exists(segments(geom), lambda s: (
        ((s["x1"] + s["x2"]) / 2 > F.lit(minx)) & ((s["x1"] + s["x2"]) / 2 < F.lit(maxx))
        & ((s["y1"] + s["y2"]) / 2 > F.lit(miny)) & ((s["y1"] + s["y2"]) / 2 < F.lit(maxy))))
    return covered & (interior | through)


# ---- buffer output (G2) ------------------------------------------------------------

def segment_capsule(seg, radius: float, arc_steps: int = 8) -> Column:
    """Polygon ring approximating the r-buffer of one segment: two half
    circles (``arc_steps`` per quarter) joined by straight sides."""
    s = _c(seg)
    n_half = 2 * arc_steps

    def arc(cx, cy, start):
        return F.transform(F.sequence(F.lit(0), F.lit(n_half)), lambda k: F.struct(
            (cx + F.lit(radius) * F.cos(start + k * F.lit(math.pi / n_half))).alias("x"),
            (cy + F.lit(radius) * F.sin(start + k * F.lit(math.pi / n_half))).alias("y")))

    # right side of the end point, around the end cap, then around the start cap
    ring = let(F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"]), lambda ang: F.concat(
        let(ang - F.lit(math.pi / 2), lambda a: arc(s["x2"], s["y2"], a)), let(ang + F.lit(math.pi / 2), lambda a: arc(s["x1"], s["y1"], a))))
    return let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))


def line_buffer(geom, radius: float, arc_steps: int = 8) -> Column:
    """Buffer of a line as a MULTIPOLYGON of per-segment capsules (not
    dissolved; the union covers exactly the points within ``radius``)."""
    segs = segments(geom)
    return F.struct(F.lit("MULTIPOLYGON").alias("kind"),
                    F.transform(segs, lambda s: F.array(segment_capsule(s, radius, arc_steps))).alias("parts"))


# ---- SQL-text forms ------------------------------------------------------------------
# The same expressions written as Spark SQL text. Building nested lambdas through
# the Column API costs one JVM round trip per node; ``F.expr`` parses the whole
# expression in one call and Catalyst yields the identical plan. Arguments are
# SQL fragments (quoted column names or expressions).

def q(name: str) -> str:
    """Quote a column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def wkt_sql(w: str) -> str:
    t = f"trim({w})"
    kind = f"upper(regexp_extract({t}, '^([A-Za-z]+)', 1))"
    body = f"regexp_replace({t}, '^[A-Za-z]+\\\\s*(ZM|Z|M)?\\\\s*', '')"
    inner = f"regexp_replace(regexp_replace({body}, '^[\\\\s(]+', ''), '[\\\\s)]+$', '')"
    vertex = ("named_struct('x', try_cast(get(split(trim(v), '\\\\s+'), 0) AS DOUBLE), "
              "'y', try_cast(get(split(trim(v), '\\\\s+'), 1) AS DOUBLE))")
    parts = (f"transform(split({inner}, '\\\\)\\\\s*\\\\)\\\\s*,\\\\s*\\\\(\\\\s*\\\\('), p -> "
             f"transform(split(p, '\\\\)\\\\s*,\\\\s*\\\\('), r -> transform(split(trim(r), '\\\\s*,\\\\s*'), v -> {vertex})))")
    parts = (f"CASE WHEN {kind} IN ('MULTILINESTRING', 'MULTIPOINT') THEN transform({parts}[0], r -> array(r)) "
             f"ELSE {parts} END")
    parts = f"CASE WHEN startswith(upper({body}), 'EMPTY') THEN array() ELSE {parts} END"
    known = f"{kind} IN ('POINT', 'LINESTRING', 'POLYGON', 'MULTIPOINT', 'MULTILINESTRING', 'MULTIPOLYGON')"
    # bound once by the outer lambda: the parse is not repeated for the check of its vertices
    return (f"element_at(transform(array(CASE WHEN {known} THEN named_struct('kind', {kind}, 'parts', {parts}) END), g -> "
            f"CASE WHEN forall(flatten(flatten(g.parts)), v -> v.x IS NOT NULL AND v.y IS NOT NULL) THEN g END), 1)")


def segments_sql(g: str, closed: bool = False) -> str:
    """The segments of all rings; ``closed`` adds a last one to rings that do not end where they begin."""
    rings = f"flatten({g}.parts)"
    if closed:
        rings = f"transform({rings}, r -> IF(size(r) > 2 AND get(r, 0) <> get(r, size(r) - 1), concat(r, slice(r, 1, 1)), r))"
    return (f"flatten(transform({rings}, r -> transform("
            f"IF(size(r) >= 2, sequence(0, size(r) - 2), array()), "
            f"i -> named_struct('x1', get(r, i).x, 'y1', get(r, i).y, 'x2', get(r, i + 1).x, 'y2', get(r, i + 1).y))))")


def crosses_sql(px: str, py: str, s: str) -> str:
    """1 if the edge ``s`` crosses the ray from the point to the right, else 0 (null edges: 0)."""
    return (f"IF({s} IS NOT NULL AND (({s}.y1 > {py}) <> ({s}.y2 > {py})) AND "
            f"({px} < ({s}.x2 - {s}.x1) * ({py} - {s}.y1) / ({s}.y2 - {s}.y1) + {s}.x1), 1, 0)")


def on_edge_sql(px: str, py: str, s: str) -> str:
    """True if the point lies on the edge ``s`` (null edges: false)."""
    return (f"({s} IS NOT NULL AND (({px} - {s}.x1) * ({s}.y2 - {s}.y1) - ({py} - {s}.y1) * ({s}.x2 - {s}.x1)) = 0.0 "
            f"AND {px} >= least({s}.x1, {s}.x2) AND {px} <= greatest({s}.x1, {s}.x2) "
            f"AND {py} >= least({s}.y1, {s}.y2) AND {py} <= greatest({s}.y1, {s}.y2))")


def pip_sql(px: str, py: str, segs: str, boundary: bool = False) -> str:
    """Even-odd test of a point against an array of edges."""
    odd = f"aggregate({segs}, 0, (a, s) -> a + {crosses_sql(px, py, 's')}) % 2 = 1"
    on = f"exists({segs}, s -> {on_edge_sql(px, py, 's')})"
    return f"(({odd}) OR {on})" if boundary else f"(({odd}) AND NOT {on})"


def vector_d2_sql(px: str, py: str, s: str) -> str:
    """Squared distance of a point to the segment ``struct<x1, y1, dx, dy, l2>``
    (its start, its vector, the vector's squared length or 1 for none); null for a
    null segment."""
    t = f"greatest(0.0D, least(1.0D, (({px} - {s}.x1) * {s}.dx + ({py} - {s}.y1) * {s}.dy) / {s}.l2))"
    ex, ey = f"({px} - ({s}.x1 + {t} * {s}.dx))", f"({py} - ({s}.y1 + {t} * {s}.dy))"
    return f"IF({s} IS NULL, NULL, {ex} * {ex} + {ey} * {ey})"


def geom_from_wkt_col(name: str) -> Column:
    """``geom_from_wkt`` of a named column, built from SQL text."""
    return F.expr(wkt_sql(q(name)))
