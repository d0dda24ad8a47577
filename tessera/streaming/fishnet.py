"""Fishnet counts as Structured Streaming queries.

The fishnet is static: its cells are computed once, and every micro-batch meets
them in a stream-static equi-join on the cell with the exact test as residual
(``operators.joins.polygon_join``), without state. Daily counts are sums of each
batch's own. Distinct points need memory: ``dropDuplicatesWithinWatermark``
keeps the points of the watermark's span and lets go of older ones; what a
batch lets through is written in a folder of its own, and the last count is
over distinct rows, so it is exact whenever a point repeats later than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefns as TF
from ..operators import joins as J
from ..plans import jobs
from ..session import ensure_checkpoint_dir
from . import hourly


def _checkpoint(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def in_fishnet(points: DataFrame, fishnet: DataFrame, **opts) -> DataFrame:
    """The streamed points joined with the static polygons that hold them."""
    return J.polygon_join(points, jobs.with_geom(fishnet).select("oid", "geom"), geom_col="geom", **opts)


def fishnet_daily_counts(points: DataFrame, fishnet: DataFrame, name: str, path: str, drop_boundary: bool = True, **opts) -> DataFrame:
    """J10 over everything available now: oid, date, join_count. ``name`` and
    ``path`` are the run's; under the same ones it goes on where it stopped."""
    if drop_boundary:
        points = points.filter(F.pmod(F.col("sys_ms"), F.lit(TF.MS_PER_DAY)) != F.lit(0))
    rows = in_fishnet(jobs.with_date(points).select("x", "y", "date"), fishnet, **opts)
    return hourly.count_batches(rows.select("oid", "date"), ["oid", "date"], name, path).withColumnRenamed("count", "join_count")


def fishnet_counts(points: DataFrame, fishnet: DataFrame, name: str, path: str, watermark: str = "1 day", **opts) -> DataFrame:
    """J11 over everything available now: oid, n_points (distinct geometries).

    ``watermark`` says how late a point may come: later ones are left out, as in
    every stream with a watermark, and equal points further apart are kept
    twice in the files, counted once.
    """
    spark = points.sparkSession
    rows = in_fishnet(hourly.with_event_time(points).select("x", "y", "evt"), fishnet, **opts).select("oid", "x", "y", "evt")
    once = rows.withWatermark("evt", watermark).dropDuplicatesWithinWatermark(["oid", "x", "y"])

    def write(batch: DataFrame, number: int) -> None:
        batch.select("oid", "x", "y").write.mode("overwrite").parquet(f"{path}/batch={number}")

    once.writeStream.option("checkpointLocation", _checkpoint(spark, name)).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    kept = spark.read.schema("oid long, x double, y double").parquet(path)
    return kept.groupBy("oid").agg(F.count_distinct("x", "y").alias("n_points"))
