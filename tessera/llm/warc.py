"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``.write.format("warc")``.

Reading plans partitions of whole files, small ones packed together, and pushes
down predicates on the record type and on the named header fields. A record's
header is parsed first; where the predicates fail, or no column of the block is
asked for, its block is passed over: by a seek in plain files and in compressed
ones whose members state their length (the ``sl`` field that the standard
proposes and this writer sets), else by inflating without keeping anything.

Writing makes files of one gzip member a record (or plain ones). A task writes
under ``_temporary``; only files of committed tasks are moved to their place,
so retried and speculative tasks leave nothing behind.

Files are opened with pyarrow's file systems (local, HDFS and object stores). Ask for
fewer columns with ``.schema(...)``. Null fields are left out of a header; control
characters in header values are percent-encoded. A damaged file raises an error
with its name and offset. An empty folder gives no rows.
"""

from __future__ import annotations

import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)

from ..sources.committed import Commit, Written, listed, store
from . import common

SCHEMA = ("record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, content_type string, content_length long, "
          "headers map<string,string>, http_head string, payload binary, payload_length long, file string, offset long")
#: Columns that are header fields; the others go by ``headers``.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
_COLUMN = {v.lower(): k for k, v in FIELDS.items()}
#: Columns that need the block.
BLOCK = {"http_head", "payload", "payload_length"}
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES, BATCH_ROWS, CHUNK = 64 << 20, 256 << 20, 8 << 20, 2000, 1 << 18
HEADER_MOST = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


# ---- reading -----------------------------------------------------------------------------

class _Input:
    """Sequential reading with a small window and seeks over what is not wanted."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        if len(self.held) < n and self.at + len(self.held) < self.size:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(CHUNK, n - len(self.held)))
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out


class _Member:
    """One gzip member, inflated as far as asked."""

    def __init__(self, source: _Input):
        self.source, self.out, self.inflate = source, b"", zlib.decompressobj(31)
        head = source.peek(12)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.start, self.length = source.at, self._stated(head)

    def _stated(self, head: bytes) -> int | None:
        """The member's length, where its ``sl`` field has it."""
        if not head[3] & 4:
            return None
        (size,) = struct.unpack_from("<H", head, 10)
        extra, at = self.source.peek(12 + size)[12:], 0
        while at + 4 <= len(extra):
            (n,) = struct.unpack_from("<H", extra, at + 2)
            if extra[at: at + 2] == b"sl" and n == 8:
                return struct.unpack_from("<I", extra, at + 4)[0]
            at += 4 + n
        return None

    def _more(self, keep: bool = True, most: int = 0) -> bool:
        """Inflate some more, ``most`` bytes if over 0."""
        data = self.source.peek(16384 if keep else CHUNK)
        if self.inflate.eof or not data:
            return False
        got = self.inflate.decompress(data, most)
        self.source.skip(len(data) - len(self.inflate.unused_data) - len(self.inflate.unconsumed_tail))
        if keep:
            self.out += got
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if len(self.out) > most or not self._more(most=4096):
                raise ValueError("no end of the header")
        out, self.out = self.out[: at], self.out[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        self.out = b""
        while have < n:
            if not self._more():
                raise ValueError("the block ends early")
            parts.append(self.out)
            have += len(self.out)
            self.out = b""
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def close(self) -> None:
        """Go to the member's end, without inflating where its length is stated."""
        if self.length is not None:
            self.source.skip(self.start + self.length - self.source.at) if self.start + self.length >= self.source.at else self._back()
            return
        while self._more(keep=False):
            pass
        if not self.inflate.eof:
            raise ValueError("the member ends early")

    def _back(self) -> None:
        self.source.at, self.source.held = self.start + self.length, b""


class _Plain:
    """One record of an uncompressed file."""

    def __init__(self, source: _Input):
        self.source, self.left = source, 0

    def until(self, mark: bytes, most: int) -> bytes:
        n = 4096
        while (at := (data := self.source.peek(n)).find(mark)) < 0:
            if len(data) < n or n > most:
                raise ValueError("no end of the header")
            n *= 4
        self.source.skip(at + len(mark))
        return data[:at]

    def take(self, n: int) -> bytes:
        out = self.source.take(n)
        if len(out) < n:
            raise ValueError("the block ends early")
        self.left -= n
        return out

    def close(self) -> None:
        self.source.skip(self.left)
        if self.source.at > self.source.size:
            raise ValueError("the block ends early")
        while self.source.peek(1) in (b"\r", b"\n") and self.source.at < self.source.size:
            self.source.skip(1)


def parse_header(text: bytes) -> dict[str, str]:
    """Fields of a record's header, by their names as written; of repeated ones the values joined."""
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", first.strip()):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip()
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _named(fields: dict[str, str]) -> dict:
    """The columns that a header gives."""
    row: dict = {"headers": {}}
    for name, value in fields.items():
        column = _COLUMN.get(name.lower())
        if column:
            row[column] = value
        elif name.lower() == "content-length":
            row["content_length"] = int(value)
        else:
            row["headers"][name] = value
    if "content_length" not in row:
        raise ValueError("no Content-Length")
    return row


def _block(row: dict, block: bytes) -> None:
    """http_head, payload and payload_length from a block. A revisit has no payload: its
    length is that of the HTTP header's Content-Length."""
    http = row.get("content_type", "").lower().replace(" ", "").startswith("application/http")
    if not http:
        row["payload"] = block if row.get("record_type") != "revisit" else None
    else:
        head, mark, rest = block.partition(b"\r\n\r\n")
        row["http_head"] = (head + mark).decode("utf-8", "replace")
        row["payload"] = rest if row.get("record_type") != "revisit" else None
        if row["payload"] is None and (stated := re.search(r"(?im)^content-length:\s*(\d+)\s*$", row["http_head"])):
            row["payload_length"] = int(stated[1])
    if row["payload"] is not None:
        row["payload_length"] = len(row["payload"])


def records(path: str, wanted: Callable[[dict], bool], columns: list[str]) -> Iterator[dict]:
    """Rows of one file's records for which ``wanted`` holds, given their header alone."""
    fs, name = store(path)
    need = bool(BLOCK & set(columns))
    size = fs.get_file_info(name).size
    with fs.open_input_file(name) as file:
        source = _Input(file, size)
        packed = source.peek(2) == b"\x1f\x8b"
        while source.at < size:
            at = source.at
            try:
                record = _Member(source) if packed else _Plain(source)
                row = _named(parse_header(record.until(b"\r\n\r\n", HEADER_MOST)))
                row |= {"file": path, "offset": at}
                length = row["content_length"]
                if not packed:
                    record.left = length
                keep = wanted(row)
                if keep and need:
                    _block(row, record.take(length))
                record.close()
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{path} at {at}: {e}") from None
            if keep:
                yield row


_TESTS = {EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
          In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v}


def _test(f) -> Callable[[dict], bool] | None:
    """A filter on a header's column as a function of the row, None if it is none."""
    if len(f.attribute) != 1 or f.attribute[0] not in (*FIELDS, "content_length"):
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda row: row.get(name) is None
    if isinstance(f, IsNotNull):
        return lambda row: row.get(name) is not None
    if isinstance(f, EqualNullSafe):
        return lambda row, x=f.value: row.get(name) == x
    if type(f) not in _TESTS or f.value is None:
        return None
    return lambda row, t=_TESTS[type(f)], x=f.value: row.get(name) is not None and t(row[name], x)


@dataclass
class WarcFiles(InputPartition):
    """Whole files of one task."""
    files: list[str]


def plan_files(path: str, most: int = PARTITION_BYTES) -> list[list[str]]:
    """The archives under ``path`` (a file or a folder), dealt into lists of at most ``most`` bytes, large files alone."""
    out, held = [], most + 1
    for file, size in sorted(listed(path, r"\.warc(\.gz)?$"), key=lambda x: (-x[1], x[0])):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(file)
        held += size
    return out


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.most = options["path"], int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.pushed: list = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if hasattr(f, "attribute") and _test(f) is not None:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self):
        return [WarcFiles(x) for x in plan_files(self.path, self.most)] or [WarcFiles([])]

    def read(self, partition):
        tests = [_test(f) for f in self.pushed]
        kinds = pa.schema([(f, _ARROW[f]) for f in self.columns])
        rows, size = [], 0
        for file in partition.files:
            for row in records(file, lambda r: all(t(r) for t in tests), self.columns):
                rows.append({c: list(row["headers"].items()) if c == "headers" else row.get(c) for c in self.columns})
                size += len(row.get("payload") or b"")
                if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


_ARROW = {**dict.fromkeys(FIELDS, pa.string()), "content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "http_head": pa.string(), "payload": pa.binary(),
          "payload_length": pa.int64(), "file": pa.string(), "offset": pa.int64()}


# ---- writing -----------------------------------------------------------------------------

def to_record(row: dict) -> bytes:
    """A record's bytes. ``headers`` are further fields; the block is ``http_head`` and ``payload``."""
    block = (row.get("http_head") or "").encode() + (row.get("payload") or b"")
    fields = [(FIELDS[c], row.get(c)) for c in FIELDS] + list(row.get("headers") or [])
    lines = ["WARC/1.1", *(f"{k}: {_CONTROL.sub(lambda m: urllib.parse.quote(m[0], safe=''), v)}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to_member(record: bytes, level: int) -> bytes:
    """A gzip member that states its length in an ``sl`` field (below 4 GB)."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = 10 + 14 + len(body) + 8
    if max(length, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(record)) + body + tail


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.job = Commit(options["path"], overwrite)
        self.packed = options.get("compression", "gzip").lower() in ("gzip", "gz")
        self.level, self.most = int(options.get("level", 6)), int(options.get("maxFileBytes", FILE_BYTES))

    def write(self, iterator):
        context = TaskContext.get()
        files, out = [], None
        info = {"record_type": "warcinfo", "date": "1970-01-01T00:00:00Z", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
        try:
            for batch in iterator:
                columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c in FIELDS or c in ("headers", "http_head", "payload")}
                for values in zip(*columns.values(), strict=True):
                    if out is None:
                        files.append(f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files)}-{self.job.run[:12]}.warc{'.gz' if self.packed else ''}")
                        out = self.job.open(files[-1])
                        self._put(out, info | {"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, files[-1])}>"})
                    self._put(out, dict(zip(columns, values, strict=True)))
                    if out.tell() >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _put(self, out, row: dict) -> None:
        record = to_record(row)
        out.write(to_member(record, self.level) if self.packed else record)

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.abort()


class WarcSource(DataSource):
    """Options: ``path``, ``maxPartitionBytes`` (reading), ``compression`` (gzip or none), ``level``, ``maxFileBytes`` (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages -------------------------------------------------------------------------------

def page_rows(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of ``pages`` (page_id, url, html): a response each, or a revisit of the
    response with the same payload of at least ``least`` bytes and the smallest page_id.

    Null html is an empty payload, a null url no target. Rows that repeat the
    smallest page_id of a payload are all responses; so are equal payloads of
    which no page_id is known.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    digested = rows.select("*", F.octet_length("payload").alias("n"), F.unhex(F.sha2("payload", 256)).alias("digest"))
    first = (digested.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
             .filter("rows > 1 AND first IS NOT NULL").select("digest", "first"))
    met = digested.join(common.if_small(common.written(first, "same-payloads")), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    unknown = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    extra = F.map_filter(F.map_from_arrays(F.array(F.lit("X-Page-ID"), F.lit("WARC-Profile")), F.array(F.col("page_id").cast("string"), F.when(again, F.lit(REVISIT)))), lambda k, v: v.isNotNull())
    return met.select(F.when(again, "revisit").otherwise("response").alias("record_type"), F.coalesce(urn("page_id"), unknown).alias("record_id"), F.lit(date).alias("date"),
                      F.col("url").alias("target_uri"), F.when(again, urn("first")).alias("refers_to"), F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"),
                      F.lit("application/http; msgtype=response").alias("content_type"), extra.alias("headers"), head.alias("http_head"), F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, least: int = 100, **options) -> None:
    """Archives of ``pages`` under ``path``, replacing what is there."""
    register(pages.sparkSession)
    common.small_batches(pages.sparkSession)
    page_rows(pages, least).write.format("warc").options(**options).mode("overwrite").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per page record of the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A response's digest and bytes are those of the payload read, a revisit's those it states."""
    register(spark)
    asked = "record_type string, refers_to string, payload_digest string, headers map<string,string>, payload binary, payload_length long"
    read = spark.read.format("warc").schema(asked).load(path).filter(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"
    return read.select(F.col("headers").getItem("X-Page-ID").cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
                       F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
                       "record_type", F.regexp_extract("refers_to", r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"))


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
         f AS (SELECT h, min(page_id) AS first, count(*) AS c FROM p WHERE n >= 100 GROUP BY h),
         m AS (SELECT p.*, CASE WHEN f.c > 1 AND f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to FROM p LEFT JOIN f USING (h))
    SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m"""
