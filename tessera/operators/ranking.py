"""Numbering of sorted sets: the place of each row among all.

``row_number()`` without ``partitionBy`` moves all rows to one task. Here rows are
dealt by range, sorted where they lie, and numbered from the sum of the rows
of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C


def numbered_rows(df: DataFrame, *order, name: str = "place", start: int = 1, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place, from ``start``, in the order of the
    given columns (names or sort columns); rows equal in all of them are numbered in any order.

    The sorted rows are written to the shared folder with the number of their
    range and their place in it, so places hold whatever task is run again. Rows
    of one hot value are parted by a hash of the whole row.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    keys = [*order, F.xxhash64(*own)]
    rows = df.withColumn("__row", F.struct(*own)).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = rows.select("__row", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"))
    held = C.written(placed.select("__row", "__part", (F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)).alias("__at")), "sorted")
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(before), "__part").select("__row.*", (F.col("__before") + F.col("__at") + F.lit(start)).cast("long").alias(name))
