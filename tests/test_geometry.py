"""WKT parsing/printing, point-in-polygon, distances, areas, buffers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import geom as G


def parse(spark, *wkts):
    df = spark.createDataFrame([(w,) for w in wkts], "wkt string")
    return df.select("wkt", G.geom_from_wkt(F.col("wkt")).alias("g"))


def test_parse_kinds_and_edge_cases(spark):
    rows = parse(spark, "POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
                 "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
                 "POINT EMPTY", "POINT Z (1 2 3)", "not wkt", "  linestring(0 0,1 1)  ").collect()
    k = [r.g.kind if r.g else None for r in rows]
    assert k == ["POINT", "LINESTRING", "POLYGON", "MULTILINESTRING", "MULTIPOLYGON", "POINT", "POINT", None, "LINESTRING"]
    assert rows[2].g.parts[0][1][0].x == 1.0 and len(rows[2].g.parts[0]) == 2
    assert len(rows[3].g.parts) == 2 and len(rows[4].g.parts) == 2
    assert rows[5].g.parts == []
    assert (rows[6].g.parts[0][0][0].x, rows[6].g.parts[0][0][0].y) == (1.0, 2.0)


def test_bad_vertex_gives_null_geometry(spark):
    rows = parse(spark, "LINESTRING (1, 2 3)", "POINT (x 1)", "POLYGON ((0 0, 1 0, 1))", "LINESTRING (0 0, 1 1)").collect()
    assert [r.g is None for r in rows] == [True, True, True, False]


def test_wkt_round_trip(spark):
    wkts = ["POINT (1 2)", "LINESTRING (0 0, 1.5 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
            "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
            "POINT EMPTY", "LINESTRING (-12935000.25 4841000, 1 -2)"]
    out = [r.w for r in parse(spark, *wkts).select(G.geom_to_wkt("g").alias("w")).collect()]
    assert out == wkts


def test_point_in_polygon_edges_holes_concave(spark):
    poly = "POLYGON ((0 0, 10 0, 10 10, 5 5, 0 10, 0 0), (2 1, 4 1, 4 3, 2 3, 2 1))"
    pts = [(1.0, 1.0, True), (3.0, 2.0, False),     # inside / inside the hole
           (5.0, 8.0, False),                       # in the notch of the concave shape
           (0.0, 5.0, False), (10.0, 0.0, False),   # on an edge / on a vertex
           (2.0, 2.0, False),                       # on the hole boundary
           (5.0, 4.9, True), (-1.0, 1.0, False)]
    df = spark.createDataFrame([(x, y, e, poly) for x, y, e in pts], "x double, y double, e boolean, wkt string")
    g = G.geom_from_wkt(F.col("wkt"))
    got = df.select("e", G.point_in_polygon(F.col("x"), F.col("y"), g).alias("w"),
                    G.point_in_polygon(F.col("x"), F.col("y"), g, boundary=True).alias("b")).collect()
    assert [r.w for r in got] == [r.e for r in got]
    assert got[3].b and got[4].b and got[5].b and not got[1].b


def test_multipolygon_membership(spark):
    df = spark.createDataFrame([(0.5, 0.2), (5.5, 5.2), (3.0, 3.0)], "x double, y double")
    g = G.geom_from_wkt(F.lit("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"))
    assert [r.w for r in df.select(G.point_in_polygon("x", "y", g).alias("w")).collect()] == [True, True, False]


def test_distances_and_zero_length_segment(spark):
    df = spark.createDataFrame([(0.0, 3.0)], "px double, py double")
    seg = F.struct(F.lit(-1.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(0.0).alias("y2"))
    zero = F.struct(F.lit(4.0).alias("x1"), F.lit(3.0).alias("y1"), F.lit(4.0).alias("x2"), F.lit(3.0).alias("y2"))
    r = df.select(G.point_segment_distance("px", "py", seg).alias("a"), G.point_segment_distance("px", "py", zero).alias("b"),
                  G.planar_distance("px", "py", F.lit(3.0), F.lit(7.0)).alias("c"),
                  F.sqrt(F.expr(G.vector_d2_sql("px", "py", "named_struct('x1', 5D, 'y1', 3D, 'dx', 0D, 'dy', 7D, 'l2', 49D)"))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (3.0, 4.0, 5.0, 5.0)


def test_area_bbox_segments(spark):
    rows = parse(spark, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
                 "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "LINESTRING (0 0, 3 4)")
    got = rows.select(G.area("g").alias("a"), G.bbox("g").alias("b"), F.size(G.segments("g")).alias("n")).collect()
    assert [r.a for r in got] == [15.0, 1.0, 0.0]
    assert tuple(got[2].b) == (0.0, 0.0, 3.0, 4.0) and [r.n for r in got] == [8, 6, 1]


def test_envelope_contains(spark):
    rows = parse(spark, "LINESTRING (1 1, 2 2)", "LINESTRING (0 0, 10 0)", "LINESTRING (0 0, 10 10)", "LINESTRING (5 5, 20 20)")
    got = [r.c for r in rows.select(G.envelope_contains("g", 0, 0, 10, 10).alias("c")).collect()]
    assert got == [True, False, True, False]


def test_line_buffer_covers_exact_band(spark):
    rows = parse(spark, "LINESTRING (0 0, 100 0, 100 100)")
    b = rows.select(G.line_buffer("g", 10.0).alias("b")).first().b
    assert b.kind == "MULTIPOLYGON" and len(b.parts) == 2
    buf = F.lit(None)
    df = spark.createDataFrame([(50.0, 9.9), (50.0, 10.5), (105.0, 50.0), (-9.0, 0.0)], "x double, y double")
    g = G.line_buffer(G.geom_from_wkt(F.lit("LINESTRING (0 0, 100 0, 100 100)")), 10.0)
    got = [r.w for r in df.select(G.point_in_polygon("x", "y", g).alias("w")).collect()]
    assert got == [True, False, True, True]
    del buf


def test_envelope_polygon_and_point_wkt(spark):
    r = spark.range(1).select(G.geom_to_wkt(G.envelope_polygon(0, 0, 2, 1)).alias("w"),
                              G.point_wkt(F.lit(1.25), F.lit(-2.0)).alias("p")).first()
    assert r.w == "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))" and r.p == "POINT (1.25 -2)"


def test_sql_text_forms_match_column_forms(spark):
    wkts = ["POINT (1 2)", "LINESTRING (0 0, 1.5 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
            "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
            "POINT EMPTY", "POINT Z (1 2 3)", "not wkt", "  linestring(0 0,1 1)  ", "POLYGON ((0 0, 3 0, 3 2, 0 2, 0 0))", None, "", "LINESTRING (1, 2 3)", "POINT (x 1)", "POLYGON ((0 0, 1 0, 1))"]
    df = spark.createDataFrame([(w,) for w in wkts], "wkt string")
    d = df.select(G.geom_from_wkt(F.col("wkt")).alias("a"), G.geom_from_wkt_col("wkt").alias("b"))
    d = d.select("a", "b", F.expr(G.segments_sql("b")).alias("sb"), G.segments("a").alias("sa"))
    for r in d.collect():
        assert r.a == r.b and r.sa == r.sb
    pts = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (0.0, 5.0), (1.5, 1.2), (2.0, 2.0)], "x double, y double")
    g = "POLYGON ((0 0, 10 0, 10 10, 5 5, 0 10, 0 0), (2 1, 4 1, 4 3, 2 3, 2 1))"
    p = pts.withColumn("g", G.geom_from_wkt(F.lit(g))).withColumn("e", G.segments("g"))
    for boundary in (False, True):
        rows = p.select(G.point_in_segments("x", "y", F.col("e"), boundary).alias("a"),
                        F.expr(G.pip_sql("x", "y", "e", boundary)).alias("b")).collect()
        assert all(r.a == r.b for r in rows)
