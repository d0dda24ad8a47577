"""Physical plans: no cartesian / nested-loop joins, no row-at-a-time Python,
pushed filters and pruned scans on the join jobs."""

import pytest

from tessera.plans import catalog

from conftest import SF_SMALL

JOIN_QUERIES = ["poi_circle_counts", "road_pairs", "road_pairs_dedupe", "road_daily_counts", "poi_daily_counts",
                "exposure_counts", "pois_near_cases", "labeled_area_counts", "fishnet_daily_counts", "fishnet_counts",
                "geohash_hourly_counts", "equal_grid_hourly_counts", "heat_pixels", "top_density"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOIN_QUERIES)
def test_no_theta_or_python_eval(spark, name):
    p = plan_of(catalog.QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, (name, bad)


def test_flagship_prunes_columns_and_broadcasts(spark):
    df = catalog.q_poi_daily_counts(spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # only the columns the job needs are read
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p


def test_top_k_is_take_ordered(spark):
    p = plan_of(catalog.q_top_count(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
