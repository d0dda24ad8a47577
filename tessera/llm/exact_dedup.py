"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after every run of white space became
one space; the SHA-256 of that text stands for it. A Misra-Gries summary per
task, merged, names the digests that make up more than a fixed share of all
rows. Their counts and winners are verified exactly, they are at most
``counters + 1`` rows, and a broadcast of them answers or drops their rows on
the map side. Only the rest is shuffled by digest, so no task gets a group
larger than that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Counters of a Misra-Gries summary: digests with over 2 / (COUNTERS + 1) of the rows are found.
COUNTERS = 1023


def digest(text: str = "text") -> F.Column:
    """Lowercase hex SHA-256 of the normalised text; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                # taking the (k+1)-th largest count from all is k+1-wise cancelling, many at a time
                floor = sorted(held.values(), reverse=True)[counters]
                held = {k: v - floor for k, v in held.items() if v > floor}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified winners of the frequent digests: digest, keep_id, group_size.

    A summary undercounts a digest by at most rows / (counters + 1), so every
    digest with over 2 / (counters + 1) of all rows passes the first test, and
    at most counters + 1 digests can. The second pass counts those exactly.
    """
    rows = digests.count()
    candidates = (digests.select("digest").mapInArrow(_summary(counters), "digest string, n long")
                  .groupBy("digest").agg(F.sum("n").alias("n"))
                  .filter(F.col("n") >= F.lit(max(2.0, rows / (counters + 1)))).select("digest"))
    return (digests.join(F.broadcast(candidates), "digest", "left_semi")
            .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))


def annotate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Rows
    that repeat a doc_id with an equal text are one document met twice: each
    counts in group_size and carries the same answer. A null doc_id never is
    keep_id unless all of its group are null; then kept is true. Other columns
    of ``docs`` play no part, and an empty table gives an empty result.
    """
    digests = common.written(common.documents_columns(docs).select("doc_id", digest().alias("digest")), "digests")
    heavy = common.written(frequent(digests, counters), "frequent")
    met = digests.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    rest = (met.filter(F.col("group_size").isNull()).select("digest", "doc_id")
            .select("digest", "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")))
    both = met.filter(F.col("group_size").isNotNull()).select("digest", "doc_id", "keep_id", "group_size").unionByName(rest)
    return both.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the smallest doc_id
    (null last; of repeated rows any one).

    Rows of frequent digests other than the winner go before the shuffle.
    """
    digests = common.written(docs.select("doc_id", digest().alias("digest")), "digests")
    heavy = common.written(frequent(digests, counters), "frequent").select("digest", "keep_id")
    # the whole row stays together in one column: no name of its own can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest().alias("digest")).join(F.broadcast(heavy), "digest", "left")
    rows = rows.filter(F.col("keep_id").isNull() | (F.col("keep_id") == F.col("id")))
    first = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    repeated = digests.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if repeated.limit(1).count():
        return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")
    # doc_ids name rows: one shuffle of ids and digests finds the copies, texts stay where they are
    light = digests.join(F.broadcast(heavy), "digest", "left_anti").withColumnRenamed("doc_id", "id")
    dropped = common.written(light.withColumn("n", F.row_number().over(first)).filter("n > 1").select(F.col("id").alias("doc_id")), "dropped")
    return common.without_ids(rows.select("row.*"), dropped)
