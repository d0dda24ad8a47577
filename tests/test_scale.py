"""Work that few bytes make is dealt over all tasks; joins in SQL text; covers without a join of pairs."""

from pyspark.sql import functions as F

from tessera.functions import sqlfuncs
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def test_sql_join_meets_in_all_tasks(spark):
    """windows are not broadcast, and are parsed in all tasks instead of in the scan's one."""
    for query in (catalog.q_sql_road_daily_counts, catalog.q_sql_poi_daily_counts, catalog.q_sql_area_daily_counts):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(spark.table(v).rdd.getNumPartitions() == n for v in ("v_roads", "v_areas", "v_pois"))
    # the parse of a window's text is in no filter below the exchange that deals the windows
    plan = catalog.q_sql_area_daily_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]


def test_sql_boxes_and_edges(spark):
    sqlfuncs.register_all(spark)
    line = "ST_GeomFromWKT('LINESTRING (0 0, 30 0, 30 40)')"
    r = spark.sql(f"SELECT ST_XMin({line}) a, ST_XMax({line}) b, ST_YMin(ST_Buffer({line}, 5)) c, ST_YMax(ST_Buffer({line}, 5)) d, size(g.edges) e FROM (SELECT {line} g)").first()
    assert tuple(r) == (0.0, 30.0, -5.0, 45.0, 2)
    moved = spark.sql(f"SELECT ST_Transform({line}, 'epsg:4326', 'epsg:3857') g").select("g.edges", "g.parts").first()
    assert (moved.edges[0].x2, moved.edges[1].y2) == (moved.parts[0][0][1].x, moved.parts[0][0][2].y)
    within = lambda x, y, g: spark.sql(f"SELECT ST_Within(ST_Point({x}D, {y}D), g) FROM (SELECT {g} AS g)").first()[0]
    assert [within(x, y, f"ST_Buffer({line}, 5D)") for x, y in ((10, 4.9), (10, 5), (34, 20), (35, 20))] == [True, False, True, False]
    ring = "ST_GeomFromText('POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 4 6, 6 6, 6 4, 4 4))')"
    assert [within(x, y, ring) for x, y in ((1, 1), (5, 5), (0, 5), (4, 5), (11, 5))] == [True, False, False, False, False]


def test_cover_counts_as_a_full_join(spark):
    """the counts of a full join of both sets of pairs, repeated and null keys too, without that join."""
    near = spark.createDataFrame([(1, 10, True), (1, 10, True), (1, 11, True), (1, 12, False), (2, 10, False), (2, None, True), (None, 9, True), (4, 1, False)], "id int, event_id int, inner boolean")
    covered = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, None), (3, 7), (3, 7), (None, 9)], "id int, event_id int")
    both = near.join(covered.withColumn("covered", F.lit(True)), ["id", "event_id"], "full")
    n = lambda c: F.count(F.when(c, 1))
    want = both.groupBy("id").agg(n(F.col("inner") & F.col("covered").isNotNull()).alias("n_inner"), n(F.col("inner") & F.col("covered").isNull()).alias("n_missed"),
                                  n(F.col("inner").isNull()).alias("n_outside")).filter("n_inner + n_missed + n_outside > 0")
    got = catalog._cover(near, covered)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    assert "FullOuter" not in catalog.q_line_buffer_cover(spark, SF)._jdf.queryExecution().executedPlan().toString()
