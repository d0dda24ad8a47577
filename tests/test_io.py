"""Sources and sinks: CSV readers with dirty rows, text lines, WKT tables,
shapefile data source, writers, SQL functions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import sqlfuncs
from tessera.sources import readers, shapefile, sinks

from shp_writer import write as write_shp


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_points_dirty_rows(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "pts.csv"),
               "lng,lat,sysTime\n116.3,39.9,1704067200000\n,39.9,1\nabc,40,2\n116.4,39.95,notatime\n-0.5,-0.25,0\n")
    rows = readers.read_points(spark, p).orderBy(F.col("sys_ms").asc_nulls_last()).collect()
    assert len(rows) == 5
    good = [r for r in rows if r.lng is not None and r.lat is not None]
    assert len(good) == 3 and any(r.sys_ms is None for r in good)
    neg = [r for r in good if r.lng == -0.5][0]
    assert neg.x < 0 and neg.y < 0


def test_read_points_positional_and_infer(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "poi.csv"), "1,x,name1,a,b,c,d,e,116.3,39.9\n2,x,name2,a,b,c,d,e,116.31,39.91\n")
    df = readers.read_points(spark, p, header=False, lng=8, lat=9, time=None, keep=["_c2"])
    assert sorted(r._c2 for r in df.collect()) == ["name1", "name2"]
    q = _write(os.path.join(tmpdir_path, "inf.csv"), "lng,lat,sysTime\n116.3,39.9,5\n")
    assert readers.read_csv(spark, q, infer=True).schema["sysTime"].dataType.typeName() in ("integer", "long")


def test_read_lines_ragged_and_header(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "lines")
    os.makedirs(d)
    _write(os.path.join(d, "a.txt"), "h1,h2\n1,2,3\n4\n")
    _write(os.path.join(d, "b.txt"), "h1,h2\n5,6\n")
    rows = sorted(tuple(r.fields) for r in readers.read_lines(spark, d).collect())
    assert rows == [("1", "2", "3"), ("4",), ("5", "6")]
    tab = _write(os.path.join(tmpdir_path, "t.txt"), "116.3\t39.9\n116.4,39.8\n")
    got = sorted(tuple(r.fields) for r in readers.read_lines(spark, tab, sep="[,\t]", skip_header=False).collect())
    assert got == [("116.3", "39.9"), ("116.4", "39.8")]


def test_read_wkt_table_pipe(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "c.csv"),
               "county_code|geom\n1|POLYGON ((0 0, 1 0, 1 1, 0 0))\n2|MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))\n")
    rows = readers.read_wkt_table(spark, p).orderBy("county_code").collect()
    assert [r.geometry.kind for r in rows] == ["POLYGON", "MULTIPOLYGON"]


def test_shapefile_source(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "roads")
    lines = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]], [[(1.0, 1.0), (2.0, 2.0)], [(3.0, 3.0), (4.5, 4.0)]]]
    write_shp(base, 3, lines, [("ID", 6), ("NAME", 10)], [(7, "ring"), (8, "two")])
    df = shapefile.read_shapefile(spark, tmpdir_path)
    rows = df.orderBy("_record").collect()
    assert [r.ID for r in rows] == ["7", "8"] and rows[1].NAME == "two"
    assert rows[0].geometry == "LINESTRING (0 0, 10 0, 10 10)"
    assert rows[1].geometry == "MULTILINESTRING ((1 1, 2 2), (3 3, 4.5 4))"
    pbase = os.path.join(tmpdir_path, "poly", "net")
    os.makedirs(os.path.dirname(pbase))
    shell = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]        # clockwise
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]          # counter-clockwise
    write_shp(pbase, 5, [[shell, hole]], [("OID_", 4)], [(3,)])
    r = shapefile.read_shapefile(spark, os.path.dirname(pbase)).first()
    assert r.OID_ == "3" and r.geometry.startswith("POLYGON ((0 0, 0 4") and r.geometry.count("(") == 3


def test_shapefile_holes_deleted_rows_and_no_index(spark, tmpdir_path):
    def ring(x, y, h, hole=False):
        r = [(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]
        return r[::-1] if hole else r
    # two shells, then the hole of the first one; an island inside a hole has a hole of its own
    shapes = [[ring(0, 0, 5), ring(20, 0, 5), ring(0, 0, 1, hole=True)], [ring(0, 0, 10), ring(0, 0, 6, hole=True), ring(0, 0, 4), ring(0, 0, 1, hole=True)], [ring(9, 9, 1)]]
    base = os.path.join(tmpdir_path, "net")
    write_shp(base, 5, shapes, [("OID_", 4)], [(1,), (2,), (3,)])
    os.rename(base + ".shx", base + ".gone")
    with open(base + ".dbf", "r+b") as f:  # the third record is deleted
        data = f.read()
        head, size = int.from_bytes(data[8:10], "little"), int.from_bytes(data[10:12], "little")
        f.seek(head + 2 * size)
        f.write(b"*")
    for path in (tmpdir_path, base, base + ".shp"):
        rows = {r.OID_: r.geometry for r in shapefile.read_shapefile(spark, path).collect()}
        assert rows.keys() == {"1", "2"}
        assert rows["1"] == "MULTIPOLYGON (((-5 -5, -5 5, 5 5, 5 -5, -5 -5), (-1 -1, 1 -1, 1 1, -1 1, -1 -1)), ((15 -5, 15 5, 25 5, 25 -5, 15 -5)))"
        assert rows["2"].count("((") == 2 and "(-10 -10, -10 10, 10 10, 10 -10, -10 -10), (-6 -6" in rows["2"] and "(-4 -4, -4 4, 4 4, 4 -4, -4 -4), (-1 -1" in rows["2"]


def test_text_sink_keeps_every_field(spark, tmpdir_path):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", None)], "id long, tag string, part string")
    sinks.write_table(df, os.path.join(tmpdir_path, "t"), fmt="text", sep=";", partition_by="part")
    rows = spark.read.text(os.path.join(tmpdir_path, "t")).collect()
    assert sorted(r.value for r in rows) == ["1;", "2;b"]


def test_sinks_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1704067200000, "a"), (2, 1735689600000, "b"), (3, 1704153600000, "c")],
                               "id long, sys_ms long, tag string")
    out = os.path.join(tmpdir_path, "csv")
    sinks.write_table(df, out, partition_by=["tag"])
    assert sorted(os.path.basename(p) for p in glob.glob(out + "/tag=*")) == ["tag=a", "tag=b", "tag=c"]
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 3
    sinks.write_table(df, os.path.join(tmpdir_path, "tsv"), sep="\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(os.path.join(tmpdir_path, "tsv")).count() == 3
    sinks.write_table(df, os.path.join(tmpdir_path, "json"), fmt="json")
    assert spark.read.json(os.path.join(tmpdir_path, "json")).count() == 3
    sinks.write_table(df, os.path.join(tmpdir_path, "txt"), fmt="text", sort_by="id")
    lines = sorted(r.value for r in spark.read.text(os.path.join(tmpdir_path, "txt")).collect())
    assert lines[0] == "1,1704067200000,a"
    sinks.split_by_year(df, os.path.join(tmpdir_path, "years"))
    years = sorted(os.path.basename(p) for p in glob.glob(os.path.join(tmpdir_path, "years", "year=*")))
    assert years == ["year=2024", "year=2025"]
    with pytest.raises(ValueError):
        sinks.regroup_by(df, "week")
    assert sinks.regroup_by(df, "month").select("month").distinct().count() == 1


def test_sql_functions(spark):
    names = sqlfuncs.register_all(spark)
    assert "geohash8" in names
    r = spark.sql("SELECT geohash8(10.40744, 57.64911) AS g, st_mercator_x(180.0) AS x, ms_hour(3600000L) AS h, "
                  "st_distance_xy(0, 0, 3, 4) AS d, tile_x(0.0, 1) AS tx, trans_lon(116.4, 39.9) AS tl").first()
    assert r.g == "u4pruydq" and abs(r.x - 20037508.342789244) < 1e-6 and r.h == 1 and r.d == 5.0 and r.tx == 1
    assert 116.39 < r.tl < 116.4
    assert spark.sql("SELECT gcj_to_wgs(116.4, 39.9).lng").first()[0] == r.tl
    null = spark.sql("SELECT geohash8(CAST(NULL AS DOUBLE), 1.0) a, geohash8(1.0, CAST(NULL AS DOUBLE)) b, ST_Point(NULL, 1.0) c, ST_GeomFromWKT('LINESTRING (1, 2 3)') d, "
                     "ST_Within(NULL, ST_Point(1, 1)) e, ST_Distance(ST_Point(1, 1), NULL) f, gcj_to_wgs(CAST(NULL AS DOUBLE), 1.0).lng g, st_mercator_x(NULL) h, ST_Area(NULL) i").first()
    assert all(v is None for v in null)
    geo = spark.sql("SELECT ST_Area(ST_PolygonFromEnvelope(0, 0, 3, 2)) a, ST_Area(ST_Buffer(ST_Point(0, 0), 2)) b, ST_Area(ST_GeomFromText('LINESTRING (0 0, 1 1)')) c, "
                    "ST_Contains(ST_PolygonFromEnvelope(0, 0, 10, 10), ST_GeomFromWKT('LINESTRING (0 0, 10 10)')) d, ST_Contains(ST_PolygonFromEnvelope(0, 0, 10, 10), ST_GeomFromWKT('LINESTRING (0 0, 10 0)')) e, "
                    "ST_Within(ST_Point(3, 0), ST_Buffer(ST_Point(0, 0), 3)) f, ST_Within(ST_Point(1, 1), ST_PolygonFromEnvelope(0, 0, 2, 2)) g, "
                    "ST_Area(ST_GeomFromWKT('MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((5 5, 6 5, 6 6, 5 5)))')) h").first()
    assert tuple(geo) == (6.0, 12.566370614359172, 0.0, True, False, False, True, 15.5)
    plan = spark.sql("SELECT st_mercator_x(id * 1.0) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_sql_utm_and_table_function(spark):
    sqlfuncs.register_all(spark)
    from tessera.functions import crs
    df = spark.createDataFrame([(116.3, 39.9), (117.0, -33.5), (119.9, 0.0), (None, 1.0)], "lng double, lat double")
    df.createOrReplaceTempView("t_utm")
    for zone, north, code in ((50, True, "epsg:32650"), (50, False, "EPSG:32750"), (51, True, "epsg:32651")):
        e, n = crs.to_utm("lng", "lat", zone, north)
        rows = spark.sql(f"SELECT lng, lat, ST_Transform(ST_Point(lng, lat), 'epsg:4326', '{code}').parts[0][0][0] AS p FROM t_utm").withColumns({"e": e, "n": n}).collect()
        for r in rows[:3]:
            assert abs(r.p.x - r.e) < 1e-6 and abs(r.p.y - r.n) < 1e-6
        assert rows[3].p is None
    back = spark.sql("SELECT ST_Transform(ST_Transform(ST_Point(116.3, 39.9), 'epsg:4326', 'epsg:3857'), 'epsg:3857', 'epsg:4326').parts[0][0][0] AS p").first().p
    assert abs(back.x - 116.3) < 1e-9 and abs(back.y - 39.9) < 1e-9
    with pytest.raises(Exception, match="st_transform"):
        spark.sql("SELECT ST_Transform(ST_Point(1, 1), 'epsg:4326', 'epsg:32661')").collect()
    cells = spark.sql("SELECT c.* FROM (SELECT ST_GeomFromWKT('LINESTRING (0 0, 25 -1)') AS g) w, LATERAL cells_of(w.g, 1D, 10D) c").collect()
    assert sorted(map(tuple, cells)) == [(x, y) for x in range(-1, 3) for y in (-1, 0)]
    spark.createDataFrame([(1, "POINT (5 5)"), (2, None), (3, "POLYGON EMPTY")], "id int, w string").createOrReplaceTempView("t_geo")
    lateral = spark.sql("SELECT g.id, c.cx FROM (SELECT id, ST_GeomFromWKT(w) AS g FROM t_geo) g, LATERAL cells_of(g.g, 0D, 10D) c")
    assert [tuple(r) for r in lateral.collect()] == [(1, 0)]
    plan = lateral._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" in plan


def test_sql_shift_runs_once(spark):
    sqlfuncs.register_all(spark)
    df = spark.sql("SELECT trans_lon(lng, lat) a, trans_lat(lng, lat) b FROM (SELECT IF(id = 0, 116.3D, NULL) AS lng, 39.9D + id AS lat FROM range(2))")
    plan = df._jdf.queryExecution().executedPlan().toString()
    udfs = [x for x in plan.split("ArrowEvalPython [")[1].split("]")[0].split("gcj_to_wgs(") if x]
    assert len(udfs) == 1 and sorted(r.a is None for r in df.collect()) == [False, True]


def test_bad_records_stay_beside_good_ones(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "p.csv"), "a,lng,lat\n1,116.3,39.9\n2,x,39.9\n3,116.3\n4,116.3,39.9,9\n5,,39.9\n\n6,1e400,nan\n")
    df = readers.read_checked(spark, p, "a long, lng double, lat double")
    rows = {r.a: r for r in df.collect()}
    assert {k: r._bad for k, r in rows.items() if r._bad} == {2: "2,x,39.9", 3: "3,116.3", 4: "4,116.3,39.9,9"} | ({6: rows[6]._bad} if rows[6]._bad else {})
    assert rows[2].lng is None and rows[2].lat == 39.9 and rows[4].lat == 39.9 and rows[5]._bad is None
    acc = readers.accounted(df, ["lng"]).first()
    assert acc.n_rows == 6 and acc.n_good + acc.n_bad == 6 and acc.n_bad >= 3 and acc.n_no_lng == 1
    # a record is as bad when other columns are asked for
    assert df.select("a", "_bad").filter("_bad IS NOT NULL").count() == acc.n_bad == df.filter("_bad IS NOT NULL").count()
    empty = _write(os.path.join(tmpdir_path, "e.csv"), "a,lng,lat\n")
    assert tuple(readers.accounted(readers.read_checked(spark, empty, "a long, lng double, lat double")).first()) == (0, 0, 0)
