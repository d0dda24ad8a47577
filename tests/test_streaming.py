"""The streaming form of A1 equals the batch form over the same files."""

import uuid

from tessera.functions.timefns import to_ms_literal
from tessera.plans import catalog
from tessera.streaming import hourly

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    s = hourly.geohash_hourly_counts_stream(spark, SF_SMALL, 8, to_ms_literal(catalog.START), to_ms_literal(catalog.END))
    b = catalog.q_geohash_hourly_counts(spark, SF_SMALL)
    assert sorted(tuple(r) for r in s.collect()) == sorted(tuple(r) for r in b.select("envelope", "date", "count").collect())


def test_grid_stream_append_mode(spark, tmpdir_path):
    from tessera.sources.fixtures import points_from_events
    src = hourly.event_stream(spark, SF_SMALL + "/events*.parquet", like=SF_SMALL + "/events.parquet")
    stream = hourly.grid_hourly_stream(points_from_events(src, mercator=False), catalog.GRID_ENVELOPE, 2, 2)
    out = hourly.run_available_now(stream, "grid_stream_" + uuid.uuid4().hex[:8], tmpdir_path + "/grid")
    rows = out.collect()
    # append mode emits only hours the watermark has passed: all but the newest
    assert len(rows) > 0 and all(r["count"] > 0 for r in rows)


def test_stream_goes_on_where_it_stopped(spark, tmpdir_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    rows.write.parquet(tmpdir_path + "/in")
    name = uuid.uuid4().hex
    for n in (1, 2, 2):
        got = hourly.count_batches(hourly.event_stream(spark, tmpdir_path + "/in"), ["k"], name, tmpdir_path + "/out")
        assert {r.k: r["count"] for r in got.collect()} == {"a": 2 * n, "b": n}
        if n == 1:
            rows.write.mode("append").parquet(tmpdir_path + "/in")


def net(spark):
    return spark.createDataFrame([(0, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"), (1, "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))")], "oid long, wkt string")


def test_fishnet_streams_equal_batch_and_go_on(spark, tmpdir_path):
    from tessera.plans import jobs
    from tessera.streaming import fishnet
    day = to_ms_literal("2024-01-03")
    first = [(1, 5.0, 5.0, day + 5), (2, 5.0, 5.0, day + 9), (3, 15.0, 5.0, day), (4, 10.0, 5.0, day + 1), (5, None, 1.0, day + 1)]
    later = [(6, 5.0, 5.0, day + 90_000_000), (7, 1.0, 1.0, day + 90_000_001), (8, 15.0, 5.0, day + 90_000_002)]
    schema, runs = "event_id long, x double, y double, sys_ms long", (uuid.uuid4().hex, uuid.uuid4().hex)
    seen = []
    for rows in (first, later, []):
        seen += rows
        if rows:
            spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(tmpdir_path + "/in")
        batch = spark.createDataFrame(seen, schema)
        for opts in ({}, {"broadcast_bytes": 0}) if not rows else ({},):
            stream = hourly.event_stream(spark, tmpdir_path + "/in", max_files_per_trigger=1)
            daily = fishnet.fishnet_daily_counts(stream, net(spark), runs[0], tmpdir_path + "/daily", **opts)
            want = jobs.fishnet_daily_counts(batch, net(spark))
            assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, want.collect()))
        distinct = fishnet.fishnet_counts(hourly.event_stream(spark, tmpdir_path + "/in"), net(spark), runs[1], tmpdir_path + "/distinct", watermark="10 days")
        assert sorted(map(tuple, distinct.collect())) == sorted(map(tuple, jobs.fishnet_counts(batch, net(spark)).collect()))


def test_table_stream_reads_nothing_else(spark, tmpdir_path):
    spark.range(5).coalesce(1).write.parquet(tmpdir_path + "/t.parquet")
    spark.range(7).coalesce(1).write.parquet(tmpdir_path + "/t.parquet2")
    got = hourly.count_batches(hourly.table_stream(spark, tmpdir_path + "/t.parquet").selectExpr("1 AS k"), ["k"], uuid.uuid4().hex, tmpdir_path + "/out")
    assert [r["count"] for r in got.collect()] == [5]
