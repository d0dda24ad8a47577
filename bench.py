"""Benchmark the headline queries.

Runs each headline query of the catalog on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Every query is run once to warm the JVM and its generated code, and then timed
on a best of two runs (result fully materialised with a ``noop`` write, so
nothing is collected to the driver). No frame is cached: a run parses, measures
and writes its window side anew. ``naive_theta_join`` has the same joins
written as a plain theta join (cross product and predicate), the baseline named
none with 0.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tessera.functions import geom as G  # noqa: E402
from tessera.operators import filters as P  # noqa: E402
from tessera.plans import catalog, jobs  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources import fixtures as FX  # noqa: E402

HEADLINE = [
    "poi_daily_counts",          # J6  flagship
    "exposure_counts",           # J7  double join with time band
    "pois_near_cases",           # J12
    "poi_circle_counts",         # J1
    "top_density",               # A11
    "road_daily_counts",         # J4  line buffer join
    "road_pairs_dedupe",         # J2
    "labeled_area_counts",       # J9  polygon join
    "fishnet_daily_counts",      # J10
    "fishnet_counts",            # J11
    "geohash_hourly_counts",     # A1
    "equal_grid_hourly_counts",  # A3
    "heat_pixels",               # T8
    "line_pixels",               # T10
    "gcj_to_wgs",                # C4
    "to_utm",                    # C3
]


REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _time(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def _pairs(points, windows, predicate):
    """What Spark plans without cells: every point against every window."""
    return points.crossJoin(F.broadcast(windows)).filter(predicate)


def _points(spark, sf, bbox=None):
    p = P.time_range(FX.points(spark, sf), catalog.START, catalog.END, whole_days=True, ts_col="ts")
    return jobs.with_date(P.within_bbox(p, bbox) if bbox else p)


def _circles(df, *names):
    return df.select(*names, F.col("x").alias("px"), F.col("y").alias("py"))


def naive_poi_daily_counts(spark, sf):
    near = G.planar_distance("x", "y", "px", "py") <= catalog.R_POI
    pts = _points(spark, sf, catalog.REFERENCE_BBOX).select("x", "y", "date")
    return _pairs(pts, _circles(FX.pois(spark, sf), "objectid"), near).groupBy("objectid", "date").count()


def naive_poi_circle_counts(spark, sf):
    near = G.planar_distance("x", "y", "px", "py") <= catalog.R_POI
    win = _circles(FX.pois(spark, sf).select("x", "y").distinct())
    return _pairs(FX.points(spark, sf).select("x", "y"), win, near).groupBy("px", "py").agg(F.count_distinct("x", "y"))


def naive_pois_near_cases(spark, sf):
    near = G.planar_distance("x", "y", "px", "py") <= catalog.R2_EXPO
    return _pairs(FX.pois(spark, sf).select("objectid", "x", "y"), _circles(FX.cases(spark, sf)), near).select("objectid").distinct()


def _road_pairs(spark, sf, points):
    """One row per road with its four segments as columns: no segment hit is counted twice."""
    roads = jobs.with_geom(FX.roads(spark, sf)).select("id", F.expr(G.segments_sql("geom")).alias("s"))
    vec = "named_struct('x1', s[{0}].x1, 'y1', s[{0}].y1, 'dx', s[{0}].x2 - s[{0}].x1, 'dy', s[{0}].y2 - s[{0}].y1, 'l2', pow(s[{0}].x2 - s[{0}].x1, 2) + pow(s[{0}].y2 - s[{0}].y1, 2))"
    roads = roads.select("id", *[F.expr(vec.format(i)).alias(f"e{i}") for i in range(4)])
    d2 = F.expr("least(" + ", ".join(G.vector_d2_sql("x", "y", f"e{i}") for i in range(4)) + ")")
    return _pairs(points, roads, d2 < F.lit(catalog.R_ROAD ** 2))


def naive_road_daily_counts(spark, sf):
    return _road_pairs(spark, sf, _points(spark, sf).select("x", "y", "date")).groupBy("id", "date").count()


def naive_road_pairs_dedupe(spark, sf):
    return _road_pairs(spark, sf, FX.points(spark, sf).select("x", "y", "lng", "lat")).select("id", "lng", "lat").distinct()


def _inside():
    return G.point_in_polygon(F.col("x"), F.col("y"), F.col("geom"))


def naive_labeled_area_counts(spark, sf):
    polys = jobs.with_geom(FX.areas(spark, sf)).select("id", "geom")
    return _pairs(P.hour_is(_points(spark, sf), 8).select("x", "y", "date"), polys, _inside()).groupBy("date").count()


def naive_fishnet_daily_counts(spark, sf):
    polys = jobs.with_geom(FX.fishnet(spark)).select("oid", "geom")
    return _pairs(_points(spark, sf).select("x", "y", "date"), polys, _inside()).groupBy("oid", "date").count()


NAIVE = {f.__name__[6:]: f for f in (naive_poi_daily_counts, naive_poi_circle_counts, naive_pois_near_cases, naive_road_daily_counts,
                                     naive_road_pairs_dedupe, naive_labeled_area_counts, naive_fishnet_daily_counts)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in sys.argv[1:] if not q.startswith("-")]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    results: dict[str, float] = {}
    for name in (only or HEADLINE):
        fn = catalog.QUERIES[name]
        _run(fn(spark, sf))                       # warm-up
        results[name] = round(min(_time(lambda: _run(fn(spark, sf))) for _ in range(REPEAT)), 3)
    naive = {}
    wanted = {"0": [], "all": list(NAIVE)}.get(os.environ.get("BENCH_NAIVE", ""), ["poi_daily_counts"])
    for name in [] if only else wanted:  # one timed run after a warm-up on no points: they grow with points x windows
        naive[name] = round(_time(lambda: _run(NAIVE[name](spark, sf))), 3)
    m = re.search(r"sf([0-9.]+)", sf)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "naive_theta_join": naive,
        "sf": float(m.group(1)) if m else sf,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
