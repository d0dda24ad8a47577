"""Token ids of documents in Simple-8b files, in ascending doc_id order.

The files are Parquet containers whose rows are segments: Spark's committed
writers reach every store and survive lost tasks, which a file opened by a
Python worker would not. A segment's ``payload`` is self-contained:

    magic "S8B1", block size u32, ids u64, documents u64, blocks u64, words u64, raw values u64
    block table  u32 x (blocks + 1)   first word of each block
    doc ids      i64 x documents      (with ``doc_null`` u8 x documents after the lengths)
    doc lengths  u64 x documents      ids of each document, end id included
    doc_null     u8  x documents      1 where the doc_id is null
    words        u64 x words          Simple-8b
    raw values   u64 x raw            of escapes

all little-endian. ``part`` and ``segment`` give the order of the segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, simple8b, tokens

#: A segment is closed at the first document's end after so many ids.
SEGMENT = 1 << 19
_HEAD = struct.Struct("<4sIQQQQQ")
SCHEMA = "part int, segment long, n_docs long, n_ids long, payload binary"


def to_payload(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = simple8b.BLOCK) -> bytes:
    """One segment's bytes."""
    words, starts, raw = simple8b.pack(ids, block)
    head = _HEAD.pack(b"S8B1", block, len(ids), len(doc_ids), len(starts) - 1, len(words), len(raw))
    return b"".join([head, starts.astype("<u4").tobytes(), np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(),
                     np.array([d is None for d in doc_ids], np.uint8).tobytes(), words.astype("<u8").tobytes(), raw.astype("<u8").tobytes()])


def from_payload(payload: bytes) -> dict:
    """A segment's parts; ``ids`` are decoded, ``words``, ``blocks`` and ``raw`` serve single blocks."""
    magic, block, n_ids, docs, blocks, words, raw = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    out, at = {"block": block, "n_ids": n_ids}, _HEAD.size
    for name, kind, n in (("blocks", "<u4", blocks + 1), ("doc_ids", "<i8", docs), ("lengths", "<u8", docs), ("doc_null", "u1", docs), ("words", "<u8", words), ("raw", "<u8", raw)):
        out[name] = np.frombuffer(payload, kind, n, at)
        at += out[name].nbytes
    return out | {"ids": simple8b.unpack(out["words"], out["raw"])}


def segments(docs: DataFrame, tokenizer: str, end: int = 0, segment: int = SEGMENT, partitions: int | None = None) -> DataFrame:
    """Segments of all documents: sorted by doc_id (null first, repeated ids by
    text), tokenised where they lie. Null texts are empty: one end id; the string of an
    added token is that token, as in the library's plain call."""
    spark = docs.sparkSession
    common.small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            body = to_payload(doc_ids, lengths, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([body], pa.binary())],
                                              names=["part", "segment", "n_docs", "n_ids", "payload"])

        for docs_here, ids, bounds in tokens.encoded(batches, tokenizer, end):
            at = 0
            while at < len(docs_here):  # up to the document with which the segment is full
                to = min(len(docs_here), 1 + int(np.searchsorted(bounds[1:], bounds[at] + segment - size)))
                doc_ids += docs_here[at:to]
                lengths += np.diff(bounds[at: to + 1]).tolist()
                held.append(ids[bounds[at]: bounds[to]])
                size += int(bounds[to] - bounds[at])
                at = to
                if size >= segment:
                    yield close()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
        if held:
            yield close()

    rows = common.documents_columns(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 0, **options) -> None:
    """Write the documents' ids as segment files under ``path``. An empty table gives an empty folder of files."""
    segments(docs, tokenizer or tokens.default_path(), end, **options).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the ids of all segments before each."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = files.select("part", "segment", "n_ids")
    within = own.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("inner"))
    starts = within.join(before, "part").select("part", "segment", (F.col("part_start") + F.col("inner")).alias("start"))
    return files.join(common.if_small(common.written(starts, "starts")), ["part", "segment"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = from_payload(payload.as_py())
                data = memoryview(x["ids"].astype("<u4").tobytes())
                to = np.cumsum(x["lengths"]).astype(np.int64)
                at = to - x["lengths"].astype(np.int64)
                crc = [zlib.crc32(data[4 * a: 4 * b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], pa.int64(), mask=x["doc_null"].astype(bool)), pa.array(at + base), pa.array(to - at), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    common.small_batches(spark)
    return read(spark, path).select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
