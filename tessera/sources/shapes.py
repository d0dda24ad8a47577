"""Shapefiles as a PySpark data source: ``format("shapes")``.

Reading plans slices of records. The ``.shx`` index has eight bytes a record, so
a slice of about ``maxPartitionBytes`` of the ``.shp`` is found by bisecting the
index; without one the record headers are walked once. A task reads its own part
of index, shapes and table, so a file of any size is many tasks. Predicates on
``minx, miny, maxx, maxy`` and the ``bbox`` option are pushed down: to the
header of a file, which may then need no task, and to those of its records,
which are then not decoded. Records become Arrow batches by numpy, not one by one.

Columns: ``geom`` (the package's geometry), ``minx`` to ``maxy``, the attributes
as text, ``_file`` and ``_record`` (from 0). Null shapes have a null geometry and
box; rows deleted in the ``.dbf`` are left out; an attribute named like another
column gets ``_attr`` appended. Files of a folder may have different attributes.

Writing takes a ``geom`` column and writes the rest as attributes: one file per
task, kind of shape and ``maxFileBytes``, shells clockwise as the format asks.

The layout follows the published ESRI Shapefile Technical Description (1998) and
the dBASE III table format.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual)

from ..functions import geom as G
from .committed import Commit, Written, listed, store
from .shapefile import DBF_HEADER_MOST, MULTIPOINT_TYPES, POINT_TYPES, POLYGON_TYPES, POLYLINE_TYPES, SHP_HEADER_BYTES, dbf_fields, polygons_of

PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 20
CHUNK_BYTES, CHUNK_RECORDS = 4 << 20, 10_000
BOX = ("minx", "miny", "maxx", "maxy")
_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_GEOM = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_VERTEX))))])


# ---- files -------------------------------------------------------------------------------

def _layers(path: str) -> list[dict]:
    """Per ``.shp`` its ``.shx`` and ``.dbf`` (None where absent) and its size."""
    if not path.lower().endswith(".shp"):
        fs, name = store(path + ".shp")
        path += ".shp" if fs.get_file_info(name).is_file else ""  # a base name
    if path.lower().endswith(".shp"):
        folder = path.rpartition("/")[0]
        all_ = {f[: -4].lower() + f[-4:].lower(): (f, n) for f, n in listed(folder, r"\.(shp|shx|dbf)$")}
        wanted = [path]
    else:
        all_ = {f[: -4].lower() + f[-4:].lower(): (f, n) for f, n in listed(path, r"\.(shp|shx|dbf)$")}
        wanted = [f for k, (f, _) in all_.items() if k.endswith(".shp")]
    out = []
    for shp in wanted:
        base = shp[:-4].lower()
        found = {ext: all_.get(f"{base}.{ext}", (None, 0)) for ext in ("shp", "shx", "dbf")}
        out.append({"shp": shp, "size": found["shp"][1], "shx": found["shx"][0], "shx_size": found["shx"][1], "dbf": found["dbf"][0]})
    return out


def _read(path: str, at: int, size: int) -> bytes:
    fs, name = store(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return f.read(size)


def _dbf(path: str | None) -> tuple[int, int, list[tuple[str, int]]]:
    return dbf_fields(_read(path, 0, DBF_HEADER_MOST)) if path else (0, 0, [])


def attribute_names(path: str) -> list[str]:
    """Of all layers under ``path``, in the order of their first appearance (a few KB of each are read)."""
    names = dict.fromkeys(n for layer in _layers(path) for n, _ in _dbf(layer["dbf"])[2])
    taken = {"geom", *BOX, "_file", "_record"}
    return [n + "_attr" if n.lower() in taken else n for n in names]


@dataclass
class Slice(InputPartition):
    """Records ``first`` to ``last`` of a file; without an index they begin at byte ``at``."""
    shp: str
    shx: str | None
    dbf: str | None
    first: int
    last: int
    at: int


def _bisected(layer: dict, most: int) -> Iterator[Slice]:
    """Slices of about ``most`` bytes by the index, of which a few entries are read for each."""
    n = (layer["shx_size"] - SHP_HEADER_BYTES) // 8
    fs, name = store(layer["shx"])
    with fs.open_input_file(name) as f:
        def offset(i: int) -> int:
            f.seek(SHP_HEADER_BYTES + 8 * i)
            return 2 * struct.unpack(">i", f.read(4))[0]

        first = 0
        while first < n:
            low, high = first + 1, n
            if layer["size"] > most:
                until = offset(first) + most
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if offset(mid) < until else (low, mid)
            else:
                low = n
            yield Slice(layer["shp"], layer["shx"], layer["dbf"], first, low, 0)
            first = low


def _walked(layer: dict, most: int) -> Iterator[Slice]:
    """Slices of a file without an index: one pass over its record headers."""
    fs, name = store(layer["shp"])
    with fs.open_input_file(name) as f:
        at, number, begun, first = SHP_HEADER_BYTES, 0, SHP_HEADER_BYTES, 0
        while at + 8 <= layer["size"]:
            if at - begun >= most:
                yield Slice(layer["shp"], None, layer["dbf"], first, number, begun)
                begun, first = at, number
            f.seek(at + 4)
            at += 8 + 2 * struct.unpack(">i", f.read(4))[0]
            number += 1
        if number > first:
            yield Slice(layer["shp"], None, layer["dbf"], first, number, begun)


# ---- filters -----------------------------------------------------------------------------

_TESTS: dict[type, Callable] = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def _test(f) -> tuple[str, type, float | None] | None:
    """(column, kind, value) of a filter on the box, else None."""
    if len(f.attribute) != 1 or f.attribute[0] not in BOX:
        return None
    if isinstance(f, IsNotNull):
        return f.attribute[0], IsNotNull, None
    if type(f) in _TESTS and isinstance(f.value, (int, float)):
        return f.attribute[0], type(f), float(f.value)
    return None


def _no_record(tests: list, box: tuple) -> bool:
    """Whether the box of a file's header shows that none of its records passes."""
    low, high = dict(zip(("minx", "miny"), box[:2])), dict(zip(("maxx", "maxy"), box[2:]))
    return any((t is LessThan and c in low and low[c] >= v) or (t is LessThanOrEqual and c in low and low[c] > v)
               or (t is GreaterThan and c in high and high[c] <= v) or (t is GreaterThanOrEqual and c in high and high[c] < v) for c, t, v in tests)


# ---- decoding ----------------------------------------------------------------------------

def _at(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Values of a fixed type at any offsets."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(buf[at[:, None] + np.arange(size)]).view(kind)[:, 0]


def _boxes(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """[records, 4]; NaN for null shapes."""
    out = np.full((len(at), 4), np.nan)
    some = np.flatnonzero(kind != 0)
    point = np.isin(kind[some], list(POINT_TYPES))
    for i in range(4):
        out[some, i] = _at(buf, at[some] + 4 + np.where(point, 8 * (i % 2), 8 * i), "<f8")
    return out


def _geometries(mem: bytes, at: np.ndarray, kind: np.ndarray) -> pa.Array:
    """The records' geometries as one Arrow array."""
    n = len(at)
    buf = np.frombuffer(mem, np.uint8)
    lines, areas = np.isin(kind, list(POLYLINE_TYPES)), np.isin(kind, list(POLYGON_TYPES))
    points, many = np.isin(kind, list(POINT_TYPES)), np.isin(kind, list(MULTIPOINT_TYPES))
    if (bad := ~(lines | areas | points | many | (kind == 0))).any():
        raise ValueError(f"unsupported shape type {kind[bad][0]}")
    ringed = lines | areas
    n_rings, n_points, first = np.zeros(n, np.int64), np.zeros(n, np.int64), at + 4
    n_rings[ringed], n_points[ringed] = _at(buf, at[ringed] + 36, "<i4"), _at(buf, at[ringed] + 40, "<i4")
    n_points[many] = _at(buf, at[many] + 36, "<i4")
    n_rings[many], n_rings[points], n_points[points] = n_points[many], 1, 1
    first = first + np.where(ringed, 40 + 4 * n_rings, np.where(many, 36, 0))
    xy = np.frombuffer(b"".join([mem[a: a + 16 * k] for a, k in zip(first.tolist(), n_points.tolist(), strict=True)]), "<f8").reshape(-1, 2)
    starts = np.frombuffer(b"".join([mem[a + 44: a + 44 + 4 * k] for a, k in zip(at[ringed].tolist(), n_rings[ringed].tolist(), strict=True)]), "<i4")
    # where each ring begins among all points
    base = np.concatenate([[0], np.cumsum(n_points)])[:-1]
    owner = np.repeat(np.arange(n), n_rings)
    begin = np.zeros(int(n_rings.sum()), np.int64)
    begin[ringed[owner]] = starts + base[owner[ringed[owner]]]
    rest = ~ringed[owner]
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_rings) - n_rings, n_rings)
    begin[rest] = base[owner[rest]] + within[rest]
    end = np.concatenate([begin[1:], [len(xy)]]) if len(begin) else begin
    order, per_part, per_record = np.arange(len(begin)), np.ones(len(begin), np.int64), n_rings.copy()
    label = np.select([points, many, lines, areas], [0, 1, np.where(n_rings == 1, 2, 3), 4], -1)
    holed = np.flatnonzero(areas & (n_rings > 1))
    if len(holed):  # holes go to their shells
        ring_base = np.cumsum(n_rings) - n_rings
        keep, taken = {}, np.zeros(n, bool)
        for r in holed.tolist():
            rings = [list(map(tuple, xy[begin[k]: end[k]].tolist())) for k in range(ring_base[r], ring_base[r] + n_rings[r])]
            number = {id(x): int(ring_base[r]) + i for i, x in enumerate(rings)}
            keep[r], taken[r] = [[number[id(x)] for x in p] for p in polygons_of(rings)], True
        pieces_order, pieces_part = [], []
        at_ring = 0
        for r in holed.tolist():
            to = int(ring_base[r])
            pieces_order.append(np.arange(at_ring, to))
            pieces_part.append(np.ones(to - at_ring, np.int64))
            pieces_order.append(np.array([k for p in keep[r] for k in p], np.int64))
            pieces_part.append(np.array([len(p) for p in keep[r]], np.int64))
            per_record[r] = len(keep[r])
            label[r] = 4 if len(keep[r]) == 1 else 5
            at_ring = to + int(n_rings[r])
        pieces_order.append(np.arange(at_ring, len(begin)))
        pieces_part.append(np.ones(len(begin) - at_ring, np.int64))
        order, per_part = np.concatenate(pieces_order), np.concatenate(pieces_part)
        size = (end - begin)[order]
        xy = xy[np.repeat(begin[order], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    else:
        size = end - begin
    def nested(values: pa.Array, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
    vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(_VERTEX))
    parts = nested(nested(nested(vertices, size), per_part), per_record)
    names = pa.array(["POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON"])
    return pa.StructArray.from_arrays([names.take(pa.array(np.maximum(label, 0))), parts.cast(_GEOM.field("parts").type)], fields=list(_GEOM), mask=pa.array(label < 0))


def _text(rows: np.ndarray) -> pa.Array:
    """A column of fixed width as trimmed text."""
    n, width = rows.shape
    data = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows))]) if width else pa.array([b""] * n, pa.binary(0))
    try:
        out = data.cast(pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([bytes(x).decode("utf-8", "replace") for x in data.to_pylist()], pa.string())
    return pc.utf8_trim(out, characters=" \t\r\n\x00\x0b\x0c")


def _chunks(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, int]]:
    """Runs of records: their numbers, content offsets in the bytes read, and the bytes."""
    fs, name = store(part.shp)
    with fs.open_input_file(name) as f:
        number, at = part.first, part.at
        while number < part.last:
            if part.shx:
                n = min(CHUNK_RECORDS, part.last - number)
                index = np.frombuffer(_read(part.shx, SHP_HEADER_BYTES + 8 * number, 8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
                start, size = index[:, 0], index[:, 1]
                run = 1 + int(np.argmax(np.r_[(start[1:] != start[:-1] + 8 + size[:-1]) | (start[1:] + 8 + size[1:] - start[0] > CHUNK_BYTES), True]))
                start, size = start[:run], size[:run]
                f.seek(int(start[0]))
                mem = f.read(int(start[-1] + 8 + size[-1] - start[0]))
                yield np.arange(number, number + run), start - start[0] + 8, mem
                number += run
            else:
                f.seek(at)
                mem, places, here = f.read(CHUNK_BYTES), [], 0
                while number + len(places) < part.last and here + 8 <= len(mem):
                    size = 8 + 2 * struct.unpack_from(">i", mem, here + 4)[0]
                    if here + size > len(mem):
                        if places:
                            break
                        mem += f.read(size - len(mem))  # a record larger than the chunk
                    places.append(here + 8)
                    here += size
                if not places:
                    return
                yield np.arange(number, number + len(places)), np.array(places, np.int64), mem[:here]
                number, at = number + len(places), at + here


class ShapeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.most, self.tests = options["path"], int(options.get("maxPartitionBytes", PARTITION_BYTES)), []
        if "bbox" in options:
            x0, y0, x1, y1 = (float(v) for v in options["bbox"].split(","))
            self.tests += [("minx", LessThanOrEqual, x1), ("miny", LessThanOrEqual, y1), ("maxx", GreaterThanOrEqual, x0), ("maxy", GreaterThanOrEqual, y0)]

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            test = _test(f) if hasattr(f, "attribute") else None
            if test:
                self.tests.append(test)
            else:
                yield f

    def partitions(self):
        out: list[Slice] = []
        for layer in _layers(self.path):
            head = _read(layer["shp"], 0, SHP_HEADER_BYTES)
            if len(head) < SHP_HEADER_BYTES or struct.unpack_from(">i", head)[0] != 9994:
                raise ValueError(f"{layer['shp']} is not a shapefile")
            if not _no_record(self.tests, struct.unpack_from("<4d", head, 36)):
                out += _bisected(layer, self.most) if layer["shx"] else _walked(layer, self.most)
        return out or [Slice("", None, None, 0, 0, 0)]

    def read(self, partition):
        if partition.first == partition.last:
            return
        head_len, rec_len, fields = _dbf(partition.dbf)
        places, pos = {}, 1
        for n, w in fields:
            places[n + "_attr" if n.lower() in {"geom", *BOX, "_file", "_record"} else n] = (pos, w)
            pos += w
        file = partition.shp.rpartition("/")[2]
        for number, at, mem in _chunks(partition):
            buf = np.frombuffer(mem, np.uint8)
            kind = _at(buf, at, "<i4")
            boxes = _boxes(buf, at, kind)
            ok = np.ones(len(at), bool)
            rows = None
            if partition.dbf:
                data = _read(partition.dbf, head_len + int(number[0]) * rec_len, rec_len * len(number))
                data += b" " * (rec_len * len(number) - len(data))  # a short table: empty attributes
                rows = np.frombuffer(data, np.uint8).reshape(len(number), rec_len)
                ok &= rows[:, 0] != ord("*")
            for column, test, value in self.tests:
                own = boxes[:, BOX.index(column)]
                ok &= ~np.isnan(own) if test is IsNotNull else _TESTS[test](own, value)
            kept = np.flatnonzero(ok)
            if not len(kept):
                continue
            columns = []
            for c in self.columns:
                if c == "geom":
                    columns.append(_geometries(mem, at[kept], kind[kept]))
                elif c in BOX:
                    columns.append(pa.array(boxes[kept, BOX.index(c)], from_pandas=True))
                elif c == "_file":
                    columns.append(pa.array([file] * len(kept), pa.string()))
                elif c == "_record":
                    columns.append(pa.array(number[kept], pa.int64()))
                elif c in places and rows is not None:
                    columns.append(_text(rows[kept, places[c][0]: places[c][0] + places[c][1]]))
                else:
                    columns.append(pa.nulls(len(kept), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)


# ---- writing -----------------------------------------------------------------------------

_TYPES = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOLYGON": 5, "MULTIPOINT": 8}
TEXT_WIDTH = 254


def _turned(ring: np.ndarray, clockwise: bool) -> np.ndarray:
    x, y = ring[:, 0], ring[:, 1]
    area = float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())
    return ring[::-1] if area != 0 and (area < 0) != clockwise else ring


def _content(geom: dict | None) -> tuple[int, bytes, np.ndarray]:
    """Shape type, record content and box of a geometry."""
    if geom is None or not geom["parts"]:
        return 0, struct.pack("<i", 0), np.full(4, np.nan)
    kind = _TYPES[geom["kind"]]
    rings = []
    for part in geom["parts"]:
        for i, ring in enumerate(part):
            xy = np.array([(v["x"], v["y"]) for v in ring], "<f8").reshape(-1, 2)
            rings.append(_turned(xy, i == 0) if kind == 5 else xy)
    xy = np.concatenate(rings)
    box = np.concatenate([xy.min(axis=0), xy.max(axis=0)])
    if kind == 1:
        return kind, struct.pack("<i", 1) + xy[0].tobytes(), box
    head = struct.pack("<i", kind) + box.astype("<f8").tobytes()
    if kind == 8:
        return kind, head + struct.pack("<i", len(xy)) + xy.tobytes(), box
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rings])[:-1]]).astype("<i4")
    return kind, head + struct.pack("<2i", len(rings), len(xy)) + starts.tobytes() + xy.tobytes(), box


class _File:
    """A layer held until it is full; the format's headers need its length and box."""

    def __init__(self, fields: list[tuple[str, int]]):
        self.fields, self.shp, self.shx, self.dbf, self.n, self.kind = fields, io.BytesIO(), io.BytesIO(), io.BytesIO(), 0, 0
        self.box = np.array([np.inf, np.inf, -np.inf, -np.inf])

    def add(self, kind: int, content: bytes, box: np.ndarray, row: bytes) -> None:
        self.kind = kind or self.kind
        self.shx.write(struct.pack(">2i", (SHP_HEADER_BYTES + self.shp.tell()) // 2, len(content) // 2))
        self.shp.write(struct.pack(">2i", self.n + 1, len(content) // 2) + content)
        self.dbf.write(b" " + row)
        self.n += 1
        if kind:
            self.box = np.concatenate([np.minimum(self.box[:2], box[:2]), np.maximum(self.box[2:], box[2:])])

    def parts(self) -> dict[str, bytes]:
        box = np.where(np.isfinite(self.box), self.box, 0.0).astype("<f8").tobytes()

        def head(size: int) -> bytes:
            return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (SHP_HEADER_BYTES + size) // 2) + struct.pack("<2i", 1000, self.kind) + box + bytes(32)
        table = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, self.n, 32 + 32 * len(self.fields) + 1, 1 + sum(w for _, w in self.fields))
        table += b"".join(struct.pack("<11sc4xBB14x", n.encode().ljust(11, b"\0"), b"C", w, 0) for n, w in self.fields) + b"\x0d"
        return {"shp": head(self.shp.tell()) + self.shp.getvalue(), "shx": head(self.shx.tell()) + self.shx.getvalue(), "dbf": table + self.dbf.getvalue() + b"\x1a", "cpg": b"UTF-8"}


class ShapeWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names = [f.name for f in schema.fields if f.name != "geom"]
        if "geom" not in schema.names or schema["geom"].dataType.simpleString() != G.GEOMETRY.simpleString():
            raise ValueError("a geom column with the package's geometry is needed")
        if len({n.lower() for n in self.names}) < len(self.names) or any(not 0 < len(n.encode()) <= 10 for n in self.names) or len(self.names) > 255:
            raise ValueError("attribute names have 1 to 10 bytes and differ, and there are 255 at most")
        if wrong := [f.name for f in schema.fields if f.name != "geom" and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]:
            raise ValueError(f"attributes can't hold {wrong}")
        self.most, self.job = int(options.get("maxFileBytes", FILE_BYTES)), Commit(options["path"], overwrite)

    def write(self, iterator):
        context, files, open_ = TaskContext.get(), [], {}
        fields = [(n, TEXT_WIDTH) for n in self.names] or [("record", 1)]

        def close(kind: int) -> None:
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{kind}-{len(files)}-{self.job.run[:12]}"
            for ext, data in open_.pop(kind).parts().items():
                with self.job.open(f"{name}.{ext}") as f:
                    f.write(data)
                files.append(f"{name}.{ext}")

        for batch in iterator:
            texts = [[(v or "").encode() for v in batch.column(n).cast(pa.string()).to_pylist()] for n in self.names]
            if any(len(v) > TEXT_WIDTH for column in texts for v in column):
                raise ValueError(f"an attribute is longer than {TEXT_WIDTH} bytes")
            rows = zip(*texts) if texts else ((b"",) for _ in range(batch.num_rows))
            for geom, row in zip(batch.column("geom").to_pylist(), rows, strict=True):
                kind, content, box = _content(geom)
                file = open_.setdefault(kind, None) or _File(fields)
                open_[kind] = file
                file.add(kind, content, box, b"".join(v.ljust(w) for v, (_, w) in zip(row, fields)))
                if file.shp.tell() + file.dbf.tell() >= self.most:
                    close(kind)
        for kind in list(open_):
            close(kind)
        return Written(files)

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.abort()


class ShapeSource(DataSource):
    """Options: ``path``, ``bbox`` ("minx,miny,maxx,maxy": records that meet it), ``maxPartitionBytes``; writing: ``maxFileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> T.StructType:
        out = T.StructType().add("geom", G.GEOMETRY)
        for n in BOX:
            out = out.add(n, T.DoubleType())
        for n in attribute_names(self.options["path"]):
            out = out.add(n, T.StringType())
        return out.add("_file", T.StringType()).add("_record", T.LongType())

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("shapes")`` known to the session and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapeSource)


def read_shapes(spark: SparkSession, path: str, bbox: tuple | None = None, **options) -> DataFrame:
    """A shapefile or a folder of them, with ``geometry`` as WKT text beside ``geom``."""
    register(spark)
    if bbox is not None:
        options["bbox"] = ",".join(repr(float(v)) for v in bbox)
    return spark.read.format("shapes").options(**options).load(path).withColumn("geometry", G.geom_to_wkt(F.col("geom")))


def write_shapes(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    register(df.sparkSession)
    df.write.format("shapes").options(**options).mode(mode).save(path)
