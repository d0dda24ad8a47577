"""Pairs of points and windows by blocks: the joins' rows, for layers with very many of them.

Points and windows meet in blocks of the plane as in ``counts``: a window's segments mark, strip by strip, runs of
the block's sorted points that lie wholly inside, and only the points that an outline may touch are tested. A run is
written out as it is, so a pair costs little more than its row. Both sides are shuffled by block and sorted, windows
before points; a task holds the windows and at most POINTS_PART points of one block's part. Its pairs leave as
they arise, as lists of a window's points, which the JVM's generated code unrolls: no group of pairs is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cells as C
from . import counts as N

#: Pairs of an Arrow batch (those of one run of points more), and rows that one row of lists unrolls to: the
#: JVM holds these at once.
PAIRS, UNROLLED = 1 << 16, 1 << 12
_AT = ["_cx", "_cy", "_p", "_w"]


def _met(kind, key: tuple, side: float, windows: pa.Table, points: pa.Table, own: list[str], others: list[str], distance: bool) -> Iterator[list[pa.Array]]:
    """The pairs of a block's part: columns ``others`` of a window, and lists of its points' columns ``own`` and of their distances."""
    x, y = points["_px"].to_numpy(), points["_py"].to_numpy()
    grid = N.Grid(x, y, key[0], key[1], side)
    x, y = x[grid.order], y[grid.order]
    whole = lambda t, c: pa.concat_arrays(t[c].chunks)
    left = [whole(points, c).take(pa.array(grid.order)) for c in own]
    right = [None if c == "_copies" else whole(windows, c) for c in others]
    copies = windows["_copies"].to_numpy().astype(np.int64) if "_copies" in others else None
    kind.read(windows)

    def lists(found: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        point, of = (np.concatenate(v) for v in zip(*found, strict=True))
        if copies is not None:  # a pair with more copies than a row unrolls to comes in several rows
            parts = -(-copies[of] // UNROLLED)
            nth = N._gathered(0 * parts, parts)
            point, of = np.repeat(point, parts), np.repeat(of, parts)
        run = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        most = np.full(len(run), UNROLLED) if copies is None else UNROLLED // np.clip(copies[of[run]], 1, UNROLLED)
        rows = -(-np.diff(np.r_[run, len(of)]) // most)
        head = np.repeat(run, rows) + N._gathered(0 * rows, rows) * np.repeat(most, rows)
        off, at, by = pa.array(np.r_[head, len(of)].astype(np.int32)), pa.array(point), pa.array(of[head])
        values = [*[v.take(at) for v in left], *([pa.array(np.sqrt(kind.distances(of, x[point], y[point])))] if distance else [])]
        each = None if copies is None else pa.array(np.minimum(copies[of[head]] - nth[head] * UNROLLED, UNROLLED).astype(np.int32))
        return [*[each if v is None else v.take(by) for v in right], *[pa.ListArray.from_arrays(off, v) for v in values]]

    found, held = [], 0
    for i, j in N._batches(np.maximum(kind.place(grid), 1), N.MARKS):
        for (a, b, window), tested in zip(N._ranges(kind, grid, i, j, len(x)), (True, False), strict=True):
            for c, d in N._batches(b - a, N.MATRIX):
                size = b[c:d] - a[c:d]
                point, of = N._gathered(a[c:d], size), np.repeat(window[c:d], size)
                if tested:
                    kept = kind.holds(of, x[point], y[point])
                    point, of = point[kept], of[kept]
                found.append((point, of))
                held += len(point)
                if held >= PAIRS:
                    yield lists(found)
                    found, held = [], 0
    if held:
        yield lists(found)


def _streamed(kind, side: float, own: list[str], others: list[str], names: list[str], distance: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, windows, points, held = None, [], [], 0

        def met() -> Iterator[pa.RecordBatch]:
            if windows and points:
                for columns in _met(kind, key, side, pa.Table.from_batches(windows), pa.Table.from_batches(points), own, others, distance):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            at = [batch.column(c).to_numpy() for c in (*_AT, "_side")]
            new = np.zeros(batch.num_rows, bool)
            for v in at:
                new[1:] |= v[1:] != v[:-1]
            new[:1] = True
            first = np.flatnonzero(new)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
                block = tuple(int(v[a]) for v in at[:4])
                if block != key:
                    yield from met()
                    key, windows, points, held = block, [], [], 0
                if at[4][a] == 0:
                    windows.append(batch.slice(a, b - a))
                elif windows:  # points of a block without windows meet nothing
                    points.append(batch.slice(a, b - a))
                    held += b - a
                    if held >= N.POINTS_PART:
                        yield from met()
                        points, held = [], 0
        yield from met()

    return run


def window_pairs(points: DataFrame, cells: DataFrame, kind, side: float, columns: list[str], point_xy=("x", "y"), copies: str | None = None) -> DataFrame:
    """One row per pair of a point record and a window: ``columns`` of the points (one at least), of ``cells`` or (of lines) ``distance``.

    ``cells``: a written table with one row per window and block (_wid, _cx, _cy, the columns of ``kind``, and others).
    Points without coordinates meet nothing. ``copies``: a column of ``cells``, how often each of a window's pairs comes.
    """
    px, py = (F.col(f"`{c}`").cast("double") for c in point_xy)
    own = {c: f"_point{i}" for i, c in enumerate(columns) if c in points.columns}
    others = {c: f"_window{i}" for i, c in enumerate(columns) if c not in own and c in cells.columns}
    distance = [c for c in columns if c not in own and c not in others]
    if not own or distance not in ([], ["distance"]):
        raise ValueError(f"no columns {distance}" if own else "no column of the points")
    if copies is not None:
        others["\0copies"] = "_copies"
    named = lambda of: [(F.col(f"`{copies}`").cast("int") if a == "_copies" else F.col(f"`{c}`")).alias(a) for c, a in of.items()]
    pts = points.select(px.alias("_px"), py.alias("_py"), *named(own)).filter("_px IS NOT NULL AND _py IS NOT NULL AND NOT isnan(_px) AND NOT isnan(_py)")
    pts = C.with_point_cell(pts, "_px", "_py", side)
    many, wide = N._parts(pts, N.POINTS_PART, "_pp"), N._parts(cells, N.WINDOWS_PART, "_wp")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    part = lambda c, *of: F.pmod(F.xxhash64(*of), F.coalesce(F.col(c), F.lit(1))).cast("int")
    dealt = lambda df: df.join(many, ["_cx", "_cy"], "left").join(wide, ["_cx", "_cy"], "left")
    p = dealt(pts).withColumn("_p", part("_pp", "_px", "_py", *own.values())).withColumn("_w", every("_wp")).drop("_pp", "_wp").withColumn("_side", F.lit(1))
    w = dealt(cells.select("_cx", "_cy", "_wid", *kind.columns, *named(others))).withColumn("_w", part("_wp", "_wid")).withColumn("_p", every("_pp"))
    w = w.drop("_pp", "_wp", "_wid").withColumn("_side", F.lit(0))
    # more tasks than cores: blocks differ in their pairs
    n = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = p.unionByName(w, allowMissingColumns=True).repartition(n, *_AT).sortWithinPartitions(*_AT, "_side")
    lists = {**own, **{c: "_distance" for c in distance}}
    types = {**{a: cells.schema[c].dataType for c, a in others.items() if a != "_copies"}, **({"_copies": T.IntegerType()} if copies is not None else {}),
             **{a: T.ArrayType(points.schema[c].dataType if c in own else T.DoubleType()) for c, a in lists.items()}}
    found = met.mapInArrow(_streamed(kind, side, [*own.values()], [*others.values()], [*types], bool(distance)), T.StructType([T.StructField(c, t) for c, t in types.items()]))
    if copies is not None:  # a window's lists are repeated, not its pairs
        found = found.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("col", "_copies")
    first, *more = lists.values()
    found = found.select("*", F.posexplode(first).alias("_at", "_first"))
    value = {first: F.col("_first"), **{a: F.get(a, F.col("_at")) for a in more}, **{a: F.col(a) for a in others.values()}}
    return found.select(*[value[{**lists, **others}[c]].alias(c) for c in columns])
