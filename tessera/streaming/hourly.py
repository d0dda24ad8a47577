"""Hourly cell counts as Structured Streaming queries.

The reference loops over hours on the driver. As a stream, points arrive as
files. ``append`` queries carry an event-time column with a watermark that
bounds the state and emit an hour once the watermark has passed it. For a
result that is exact at any time without state, ``count_batches`` writes each
micro-batch's partial counts as one folder and sums them on reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geohash import with_geohash
from ..functions.timefns import ms_to_hour_str
from ..operators.aggs import equal_grid_cell
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import points_from_events


def event_stream(spark: SparkSession, path: str, like: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the ``events`` files under ``path`` (a folder or a glob); the
    schema is taken from ``like`` (a batch path) since file streams need one."""
    schema = spark.read.parquet(like or path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def table_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream one Parquet file or folder. A file stream takes folders and globs only:
    the path becomes a glob that nothing else matches."""
    return event_stream(spark, f"{path[:-1]}[{path[-1]}]", like=path, max_files_per_trigger=max_files_per_trigger)


def with_event_time(points: DataFrame, ms_col: str = "sys_ms") -> DataFrame:
    """Event-time column (an instant, independent of the session zone)."""
    return points.withColumn("evt", F.timestamp_millis(F.col(ms_col)))


def geohash_hourly_stream(points: DataFrame, precision: int = 8, watermark: str = "1 hour",
                          lng: str = "lng", lat: str = "lat") -> DataFrame:
    """A1 on a stream: points per (geohash, hour) with a watermark."""
    p = with_geohash(with_event_time(points).withWatermark("evt", watermark), lng, lat, precision, "envelope")
    agg = p.groupBy(F.window("evt", "1 hour").alias("w"), "envelope") \
        .agg(F.count(F.lit(1)).alias("count"))
    start_ms = F.unix_millis(F.col("w.start"))
    return agg.select("envelope", ms_to_hour_str(start_ms).alias("date"), "count")


def grid_hourly_stream(points: DataFrame, envelope, nx: int, ny: int,
                       watermark: str = "1 hour", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """A3 counts on a stream (non-empty cells only; zero-filling needs the
    finished hour, see ``equal_grid_hourly_counts`` for the batch form)."""
    p = with_event_time(points).withWatermark("evt", watermark)
    p = p.withColumn("cell", equal_grid_cell(lng, lat, envelope, nx, ny)).filter(F.col("cell").isNotNull())
    agg = p.groupBy(F.window("evt", "1 hour").alias("w"), "cell").agg(F.count(F.lit(1)).alias("count"))
    return agg.select(ms_to_hour_str(F.unix_millis(F.col("w.start"))).alias("hour"), "cell", "count")


def run_available_now(df: DataFrame, name: str, path: str) -> DataFrame:
    """Append a streaming frame's output over everything available now to the
    Parquet folder ``path`` and return what it holds. The checkpoint, named by
    ``name``, lies in the session's shared checkpoint folder, so a restarted
    job resumes instead of recounting."""
    spark = df.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = df.writeStream.outputMode("append").option("checkpointLocation", ckpt).trigger(availableNow=True).format("parquet").option("path", path).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def count_batches(rows: DataFrame, keys: list[str], name: str, path: str) -> DataFrame:
    """Counts per ``keys`` over a stream of rows, without state.

    Each micro-batch overwrites its own folder with its partial counts, so a
    batch that runs twice counts once; the returned frame sums them. A restart
    under the same ``name`` and ``path`` goes on where it stopped.
    """
    spark = rows.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.select(*keys).writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("count"))


def geohash_hourly_counts_stream(spark: SparkSession, sf_dir: str, precision: int = 8,
                                 start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """A1 over the ``events`` table as a bounded stream, in a run of its own."""
    src = table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    pts = points_from_events(src, mercator=False)
    if start_ms is not None:
        pts = pts.filter(F.col("sys_ms") > F.lit(start_ms))
    if end_ms is not None:
        pts = pts.filter(F.col("sys_ms") < F.lit(end_ms))
    rows = with_geohash(pts, "lng", "lat", precision, "envelope").select("envelope", ms_to_hour_str("sys_ms").alias("date"))
    run = uuid.uuid4().hex
    return count_batches(rows, ["envelope", "date"], run, f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream_tables/{run}")
