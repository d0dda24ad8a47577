"""Semi and anti joins, numbering, gap filling, bounded partitioned writes."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggs as A
from tessera.operators import joins as J
from tessera.operators import ranking
from tessera.plans import jobs
from tessera.sources import sinks

from test_joins import _even_odd, _square, brute_pairs, rnd_points


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


OPTS = [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "salt": True, "hot_rows": 20}]


@pytest.mark.parametrize("opts", OPTS)
def test_circle_semi_and_anti_join(spark, opts):
    pts, wins = [*rnd_points(1, 300), (900, None, 1.0)], rnd_points(2, 30)
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    w = spark.createDataFrame(wins, "pid long, x double, y double")  # clashing names
    near = {i for i, _ in brute_pairs(pts[:-1], wins, 60.0)}
    semi, anti = (J.distance_join(p, w, 60.0, how=h, **opts) for h in ("left_semi", "left_anti"))
    assert sorted(r.pid for r in semi.collect()) == sorted(near)
    assert sorted(r.pid for r in anti.collect()) == sorted({i for i, *_ in pts} - near)
    assert semi.columns == p.columns
    plan = plan_of(semi)
    assert "LeftSemi" in plan and "HashAggregate" not in plan.split("LeftSemi")[0] and "LeftAnti" in plan_of(anti)
    with pytest.raises(ValueError):
        J.distance_join(p, w, 60.0, how="full")


@pytest.mark.parametrize("opts", OPTS)
def test_line_and_polygon_semi_and_anti_join(spark, opts):
    pts = rnd_points(3, 400, grid=5.0)
    p = spark.createDataFrame([(i, x, y) for i, x, y in pts], "pid long, x double, y double")
    lines = spark.createDataFrame([(1, "LINESTRING (-300 0, 300 0)"), (2, "LINESTRING (0 -300, 0 300)")], "id long, wkt string")
    near = {i for i, x, y in pts if (abs(y) < 40 and abs(x) <= 300) or (abs(x) < 40 and abs(y) <= 300) or min(((x - a) ** 2 + (y - b) ** 2) for a, b in ((300, 0), (-300, 0), (0, 300), (0, -300))) < 1600}
    assert {r.pid for r in jobs.points_off_roads(p, lines, 40.0, **opts).collect()} == {i for i, *_ in pts} - near
    on = jobs.points_off_roads(p, lines, 40.0, how="left_semi", **opts)
    assert sorted(r.pid for r in on.collect()) == sorted(near) and "LeftSemi" in plan_of(on)
    areas = spark.createDataFrame([(i, _square(x, y, 120.0)) for i, x, y in ((1, 0.0, 0.0), (2, 50.0, 50.0), (3, -300.0, 200.0))], "id long, wkt string")
    rings = [[(x - 120, y - 120), (x + 120, y - 120), (x + 120, y + 120), (x - 120, y + 120), (x - 120, y - 120)] for x, y in ((0, 0), (50, 50), (-300, 200))]
    inside = {i for i, x, y in pts if any(_even_odd(x, y, [r]) for r in rings)}
    got = jobs.points_in_areas(p, areas, **opts)
    assert sorted(r.pid for r in got.collect()) == sorted(inside) and "LeftSemi" in plan_of(got)
    assert {r.pid for r in jobs.points_in_areas(p, areas, how="left_anti", **opts).collect()} == {i for i, *_ in pts} - inside


def test_pois_near_several_cases_come_once(spark):
    pois = spark.createDataFrame([(1, 0.0, 0.0), (2, 99.0, 0.0)], "objectid long, x double, y double")
    cases = spark.createDataFrame([(1.0, 0.0, "a"), (2.0, 0.0, "b")], "x double, y double, date string")
    df = jobs.pois_near_cases(pois, cases, 10.0)
    assert [r.objectid for r in df.collect()] == [1] and "LeftSemi" in plan_of(df) and "Aggregate" not in plan_of(df).split("LeftSemi")[0]


# ---- numbering -----------------------------------------------------------------------------

def test_numbered_rows(spark):
    r = random.Random(5)
    data = [(r.choice([None, 7, 7, 7, r.randint(0, 50)]), i) for i in range(2000)]  # a hot value and nulls
    df = spark.createDataFrame(data, "v int, i int").repartition(7)
    for order, key in (((F.col("v"), "i"), lambda t: (t[0] is not None, t[0] or 0, t[1])), ((F.col("v").desc_nulls_last(), F.col("i").desc()), lambda t: (t[0] is None, -(t[0] or 0), -t[1]))):
        out = ranking.numbered_rows(df, *order, name="n", start=0)
        got = [(x.v, x.i) for x in sorted(out.collect(), key=lambda x: x.n)]
        assert got == sorted(data, key=key) and out.columns == ["v", "i", "n"]
        assert sorted(x.n for x in out.collect()) == list(range(2000))
    assert ranking.numbered_rows(df.limit(0), "v").collect() == []
    hot = ranking.numbered_rows(spark.range(500).select(F.lit(1).alias("v"), "id"), "v", partitions=8)
    assert sorted(x.place for x in hot.collect()) == list(range(1, 501))
    plan = plan_of(hot)
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


# ---- gap filling ---------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 3, 10, 1 << 16])
def test_dense_cells(spark, block):
    data = [("a", 0, 5), ("a", 3, 2), ("b", 9, 1), ("c", 4, 7)]
    df = spark.createDataFrame(data, "g string, cell long, n long")
    out = A.dense_cells(df, "g", 10, block=block)
    want = sorted((g, c, sum(n for g2, c2, n in data if (g2, c2) == (g, c))) for g in "abc" for c in range(10))
    assert sorted((r.g, r.cell, r.n) for r in out.collect()) == want
    assert A.dense_cells(df.limit(0), "g", 10, block=block).count() == 0


def test_a_million_cells_need_no_map_or_nested_loop(spark):
    ms = 1_704_067_200_000
    p = spark.range(2000).select((F.rand(1) * 100).alias("lng"), (F.rand(2) * 100).alias("lat"), (F.lit(ms + 1) + F.col("id")).alias("sys_ms"))
    d = A.equal_grid_hourly_counts(p, "2024-01-01", "2024-01-02", (0.0, 0.0, 100.0, 100.0), 1000, 1000)
    assert tuple(d.agg(F.count("*"), F.sum("count")).first()) == (1_000_000, 2000)
    assert "Join" not in plan_of(d) and "map_from_entries" not in plan_of(d)


# ---- partitioned writes --------------------------------------------------------------------

def test_folders_have_a_bounded_number_of_files(spark, tmpdir_path):
    tasks, hours = 16, 24
    df = spark.range(0, 20_000, 1, tasks).select(F.col("id").alias("event_id"), (F.lit(1_704_067_200_000) + F.col("id") * 4000).alias("sys_ms"))
    sinks.write_table(sinks.regroup_by(df.repartition(tasks), "date_hour"), f"{tmpdir_path}/h", partition_by="date_hour")
    files = glob.glob(f"{tmpdir_path}/h/*/*.csv")
    assert len({os.path.dirname(f) for f in files}) >= 22 and len(files) <= hours + tasks
    back = spark.read.option("header", True).csv(f"{tmpdir_path}/h")
    assert back.count() == 20_000 and back.select("event_id").distinct().count() == 20_000


def test_files_of_a_hot_folder_are_split(spark, tmpdir_path):
    df = spark.range(10_000).select("id", F.lit("one").alias("k"))
    sinks.write_table(df, f"{tmpdir_path}/k", fmt="parquet", partition_by="k", rows_per_file=1500)
    files = glob.glob(f"{tmpdir_path}/k/k=one/*.parquet")
    assert len(files) >= 7 and all(spark.read.parquet(f).count() <= 1500 for f in files)
