"""Helpers shared by the operators of this package: tables, scratch, broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import measured
from ..session import ensure_checkpoint_dir

#: Arrow batches handed to Python hold at most this many rows and bytes.
ARROW_ROWS, ARROW_BYTES = "2000", str(4 << 20)
#: Bytes of a table that may be broadcast, estimated from above.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes, so that
    very long texts cannot pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again.

    Cuts lineage in a way that outlives the loss of any executor.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its measured bytes (texts and nested
    columns by what they hold) are within the bound; beyond it Spark plans a
    shuffle join. Same rows either way."""
    return F.broadcast(df) if measured(df)[0] <= max_bytes else df


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``dropped`` (one long column
    doc_id, a written table). Rows with a null doc_id stay."""
    ids = if_small(dropped).withColumnRenamed("doc_id", "__dropped")
    return docs.join(ids, docs["doc_id"] == ids["__dropped"], "left_anti")


def documents_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text only, by position-independent name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row. Spark inlines a
    projected column into every place that names it, inside lambdas too, where
    it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
