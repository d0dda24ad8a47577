"""The shapes data source: planned record ranges, pushdown, every kind of shape, writing."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import geom as G
from tessera.plans import jobs
from tessera.sources import shapefile, shapes

from shp_writer import write as write_shp


def wkts(df, attr="ID"):
    return sorted((r[attr], r.geometry) for r in df.collect())


def random_shapes(kind, n, seed=1):
    r = random.Random(seed)

    def ring(x, y, h, hole=False):
        v = [(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]
        return v[::-1] if hole else v
    out = []
    for _ in range(n):
        x, y = r.randint(-500, 500), r.randint(-500, 500)
        if kind == 1:
            out.append((float(x), y + 0.5))
        elif kind == 3:
            out.append([[(x + r.randint(-9, 9), y + r.randint(-9, 9)) for _ in range(r.randint(2, 30))] for _ in range(r.randint(1, 3))])
        else:
            rings = [ring(x, y, 9.0)] + [ring(x, y, 4.0, hole=True)] * (r.random() < 0.4) + [ring(x + 40, y, 5.0)] * (r.random() < 0.4)
            r.shuffle(rings)
            out.append(rings)
    return out


@pytest.mark.parametrize("kind", [1, 3, 5])
@pytest.mark.parametrize("index", [True, False])
def test_slices_of_a_file_give_the_whole_file(spark, tmpdir_path, kind, index):
    data = random_shapes(kind, 400)
    write_shp(f"{tmpdir_path}/a", kind, data, [("ID", 6), ("NAME", 12)], [(i, f"näme {i % 7}") for i in range(400)])
    want = wkts(shapefile.read_shapefile(spark, tmpdir_path))
    if not index:
        os.remove(f"{tmpdir_path}/a.shx")
    df = shapes.read_shapes(spark, tmpdir_path, maxPartitionBytes=4000)
    assert df.rdd.getNumPartitions() > 2
    assert wkts(df) == want and sorted(r._record for r in df.collect()) == list(range(400))
    assert wkts(shapes.read_shapes(spark, f"{tmpdir_path}/a.shp")) == wkts(shapes.read_shapes(spark, f"{tmpdir_path}/a")) == want
    r = df.filter("_record = 5").first()
    pts = [data[5]] if kind == 1 else [p for part in data[5] for p in part]
    assert (r.minx, r.miny, r.maxx, r.maxy) == (min(x for x, _ in pts), min(y for _, y in pts), max(x for x, _ in pts), max(y for _, y in pts))


def test_box_predicates_are_answered_by_the_source(spark, tmpdir_path):
    write_shp(f"{tmpdir_path}/a", 5, random_shapes(5, 300), [("ID", 6)], [(i,) for i in range(300)])
    all_ = shapes.read_shapes(spark, tmpdir_path).collect()
    df = shapes.read_shapes(spark, tmpdir_path, maxPartitionBytes=5000).filter("minx <= 100 AND maxx >= -100 AND miny < 0 AND maxy > -300")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    want = sorted(r.ID for r in all_ if r.minx <= 100 and r.maxx >= -100 and r.miny < 0 and r.maxy > -300)
    assert sorted(r.ID for r in df.collect()) == want and 0 < len(want) < 300
    got = shapes.read_shapes(spark, tmpdir_path, bbox=(-100, -300, 100, 0)).collect()
    assert sorted(r.ID for r in got) == sorted(r.ID for r in all_ if r.minx <= 100 and r.maxx >= -100 and r.miny <= 0 and r.maxy >= -300)
    none = shapes.read_shapes(spark, tmpdir_path).filter("minx > 1000000")
    assert none.count() == 0
    reader = shapes.ShapeReader(shapes.ShapeSource({"path": tmpdir_path}).schema(), {"path": tmpdir_path, "bbox": "1e6,1e6,2e6,2e6"})
    assert [p.last for p in reader.partitions()] == [0]  # the file's header suffices


def test_null_deleted_and_short_tables(spark, tmpdir_path):
    base = f"{tmpdir_path}/a"
    write_shp(base, 1, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], [("geom", 4), ("_FILE", 5)], [("x", "a"), ("y", "b"), ("z", "c")])
    with open(base + ".dbf", "r+b") as f:
        f.seek(32 + 64 + 1 + 10)
        f.write(b"*")  # the second row
        f.truncate(32 + 64 + 1 + 20)  # the third is missing
    data = open(base + ".shp", "rb").read()
    with open(base + ".shp", "wb") as f:  # the first becomes a null shape, of which the index knows
        f.write(data[:108] + struct.pack("<i", 0) + data[112:])
    rows = shapes.read_shapes(spark, tmpdir_path).orderBy("_record").collect()
    assert [(r._record, r.geom_attr, r._FILE_attr, r.geometry, r.minx) for r in rows] == [(0, "x", "a", None, None), (2, "", "", "POINT (5 6)", 5.0)]
    os.remove(base + ".dbf")
    assert shapes.read_shapes(spark, tmpdir_path).columns == ["geom", "minx", "miny", "maxx", "maxy", "_file", "_record", "geometry"]
    assert shapes.read_shapes(spark, tmpdir_path).filter("minx IS NOT NULL").count() == 2


def test_layers_of_different_attributes(spark, tmpdir_path):
    write_shp(f"{tmpdir_path}/a", 1, [(1.0, 2.0)], [("A", 4)], [("x",)])
    os.makedirs(f"{tmpdir_path}/sub")
    write_shp(f"{tmpdir_path}/sub/B", 3, [[[(0.0, 0.0), (1.0, 1.0)]]], [("B", 4)], [("y",)])
    rows = shapes.read_shapes(spark, tmpdir_path).orderBy("_file").collect()
    assert [(r.A, r.B, r.geom.kind) for r in rows] == [(None, "y", "LINESTRING"), ("x", None, "POINT")]


WKT = ["POINT (1 2)", "MULTIPOINT ((1 2), (3 4))", "LINESTRING (0 0, 1 1, 2 0)", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5))",
       "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 1 0, 0 0)), ((5 5, 5 9, 9 9, 9 5, 5 5), (6 6, 7 6, 7 7, 6 7, 6 6)))", None]


def test_every_kind_is_written_and_read_back(spark, tmpdir_path):
    df = jobs.with_geom(spark.createDataFrame([(i, w, f"ä{i}") for i, w in enumerate(WKT)], "id int, wkt string, name string")).select("id", "name", "geom")
    for extra in ({}, {"maxFileBytes": "10"}):
        shapes.write_shapes(df.coalesce(2), f"{tmpdir_path}/out", **extra)
        back = {int(r.id): r for r in shapes.read_shapes(spark, f"{tmpdir_path}/out").collect()}
        assert {k: r.name for k, r in back.items()} == {i: f"ä{i}" for i in range(len(WKT))}
        for i, w in enumerate(WKT):
            if w is None:
                assert back[i].geom is None
                continue
            kind = back[i].geom.kind
            assert kind == w.split(" ")[0]
            if not kind.endswith("POLYGON"):
                assert back[i].geometry == w
        areas = shapes.read_shapes(spark, f"{tmpdir_path}/out").withColumn("a", G.area(F.col("geom"))).collect()
        assert {int(r.id): r.a for r in areas if r.geom is not None and r.geom.kind.endswith("POLYGON")} == {4: 15.0, 5: 16.0}
        old = {r.id: r.geometry for r in shapefile.read_shapefile(spark, f"{tmpdir_path}/out").collect()}
        assert old == {str(k): r.geometry for k, r in back.items()}


def test_what_cannot_be_written(spark, tmpdir_path):
    df = jobs.with_geom(spark.createDataFrame([(1, "POINT (1 2)")], "id int, wkt string"))
    for bad in (df.drop("geom"), df.select("geom", F.lit(1).alias("name_of_11b")), df.select("geom", F.array(F.lit(1)).alias("a")), df.select("geom", F.repeat(F.lit("x"), 255).alias("a"))):
        with pytest.raises(Exception, match="geom column|attribute"):
            shapes.write_shapes(bad, f"{tmpdir_path}/out")
    assert not os.path.exists(f"{tmpdir_path}/out/_SUCCESS") and not os.path.exists(f"{tmpdir_path}/out/_temporary")
    shapes.write_shapes(df.select("geom").limit(0), f"{tmpdir_path}/none")
    assert shapes.read_shapes(spark, f"{tmpdir_path}/none").count() == 0


def test_not_a_shapefile(spark, tmpdir_path):
    open(f"{tmpdir_path}/a.shp", "wb").write(b"x" * 200)
    with pytest.raises(Exception, match="not a shapefile"):
        shapes.read_shapes(spark, tmpdir_path).count()
