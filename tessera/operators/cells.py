"""Grid cells: the spatial index of every join in this package.

A spatial theta join (distance, within, buffer) has no Catalyst strategy; on
its own it plans as a nested-loop or cartesian product. We turn it into an
equi-join: each point falls in exactly one cell ``(floor(x/s), floor(y/s))``;
each window is replicated to the cells it can match in. Joining on the cell
finds every candidate pair exactly once, and an exact residual predicate keeps
the true matches. Points are read once and never replicated: a layer has one
cell size, coarse enough to bound its window rows.

Also here: the broadcast bounded by bytes and, for sessions without adaptive
skew joins, the salting of hot cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# A window side up to this size (rows times widths, measured) is broadcast.
BROADCAST_BYTES = 64 << 20
# A cell holding more rows than this is split by the salted path.
HOT_ROWS = 1_000_000
# Window rows of a layer: at most this many cells a window on average, plus a floor.
CELLS_PER_WINDOW, CELLS_FLOOR = 16, 4096


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cell_index(v, size: float) -> Column:
    """Cell number of a coordinate: ``floor(v / size)`` (floor, not truncate,
    so negative coordinates are handled)."""
    return F.floor(_c(v) / F.lit(float(size))).cast("long")


def with_point_cell(df: DataFrame, x: str, y: str, size: float, prefix: str = "_c") -> DataFrame:
    return df.withColumn(prefix + "x", cell_index(x, size)).withColumn(prefix + "y", cell_index(y, size))


def explode_range(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
    """One row per integer in [lo, hi], none if lo > hi (a generator, not a join)."""
    lo, hi = lo.cast("long"), hi.cast("long")
    return df.withColumn(name, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))


def explode_bbox_cells(df: DataFrame, minx, miny, maxx, maxy, size: float, prefix: str = "_c") -> DataFrame:
    """Replicate each row to every cell its bounding box touches."""
    df = explode_range(df, cell_index(minx, size), cell_index(maxx, size), prefix + "x")
    return explode_range(df, cell_index(miny, size), cell_index(maxy, size), prefix + "y")


def explode_disc_cells(df: DataFrame, x: str, y: str, radius: float, size: float, prefix: str = "_c") -> DataFrame:
    """Replicate each centre to the cells its radius-``radius`` disc can touch
    (3×3 when size ≥ radius)."""
    r = F.lit(radius)
    return explode_bbox_cells(df, _c(x) - r, _c(y) - r, _c(x) + r, _c(y) + r, size, prefix)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a new Parquet table in the shared checkpoint folder, read again.

    Window sides feed a few decisions (cell size, bytes) and the join itself.
    A written table parses their geometry once, outlives executors, and belongs
    to this call alone, so a replaced input file is always read anew.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over all tasks. A table of windows is small in bytes, so that it is read (or
    coalesced after a shuffle) in one task or two, but its geometries are much work to parse."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _fixed(t: T.DataType) -> int | None:
    """Bytes of a value of a type without variable parts, None with them."""
    if isinstance(t, T.StructType):
        own = [_fixed(f.dataType) for f in t.fields]
        return None if None in own else 16 + sum(own)
    return None if isinstance(t, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType)) else 8


def _bytes_sql(t: T.DataType, e: str, depth: int = 0) -> str:
    """SQL for about the bytes of a value in memory, nested ones by their entries."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return f"(24L + coalesce(octet_length({e}), 0))"
    if isinstance(t, T.ArrayType):
        width = _fixed(t.elementType)
        if width is not None:
            return f"(24L + {width} * coalesce(greatest(size({e}), 0), 0))"
        a, x = f"a{depth}", f"x{depth}"
        return f"coalesce(aggregate({e}, 24L, ({a}, {x}) -> {a} + {_bytes_sql(t.elementType, x, depth + 1)}), 24L)"
    if isinstance(t, T.MapType):
        return f"({_bytes_sql(T.ArrayType(t.keyType), f'map_keys({e})', depth)} + {_bytes_sql(T.ArrayType(t.valueType), f'map_values({e})', depth)})"
    if isinstance(t, T.StructType):
        return "(24L + " + " + ".join([_bytes_sql(f.dataType, f"{e}.`{f.name}`", depth) for f in t.fields] or ["0"]) + ")"
    if isinstance(t, T.VariantType):
        return f"(24L + coalesce(octet_length(to_json({e})), 0))"
    return "24L"


def measured(df: DataFrame, *arrays: str) -> tuple[int, ...]:
    """Upper estimate of a window side's bytes in memory (24 a column, texts,
    arrays, structs and maps by what they hold), and the most entries of each of
    ``arrays``. One aggregate."""
    sizes = [f"sum({_bytes_sql(f.dataType, '`' + f.name.replace('`', '``') + '`')})" for f in df.schema.fields]
    most = [F.max(F.size(a)) for a in arrays]
    rows, *found = df.agg(F.count(F.lit(1)), *most, *[F.expr(s) for s in sizes]).first()
    return (24 * rows + sum(int(v or 0) for v in found[len(arrays):]), *(max(0, int(v or 0)) for v in found[: len(arrays)]))


def salt_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS,
                  salt_cols: list[str] | None = None):
    """Split hot join keys of ``left`` over as many parts as their rows ask for.

    Hot keys have at least ``hot_rows`` rows on the left (counted with a partial
    aggregate); there can be no more of them than rows / hot_rows. A left row of
    a hot key gets a salt from a hash of its own columns (stable under task
    retry), a right row is repeated once per salt of its key. Other keys keep
    salt 0. Returns the two frames and the extended key list.
    """
    hot = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= F.lit(hot_rows))
           .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts")))
    cols = salt_cols or left.columns
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    lh = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), parts).cast("int")).drop("_parts")
    rh = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return lh, rh, keys + ["_salt"]


HOW = ("inner", "left_semi", "left_anti")


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], *, right_bytes: int, how: str = "inner", residual: Column | None = None,
              broadcast_bytes: int = BROADCAST_BYTES, salt: bool = False, hot_rows: int = HOT_ROWS,
              salt_cols: list[str] | None = None) -> DataFrame:
    """Equi-join of point cells (left) with window cells (right).

    Right is broadcast when its measured size is within the bound (no shuffle
    of the big side, no skew). Otherwise both sides shuffle on the cell and
    adaptive execution splits hot cells at run time; ``salt`` splits them
    beforehand, at the cost of a pass that counts cells, for sessions that run
    without adaptive skew joins.

    ``how`` is inner (candidates, of which the caller keeps those that pass its
    residual), ``left_semi`` or ``left_anti``. For those two the ``residual`` is
    part of the join condition, so that Spark leaves a point's candidates at the
    first window that holds it.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    broadcast = right_bytes <= broadcast_bytes
    if salt and not broadcast:
        left, right, keys = salt_hot_keys(left, right, keys, hot_rows, salt_cols)
    right = F.broadcast(right) if broadcast else right.hint("merge")
    if how == "inner":
        return left.join(right, keys, "inner").drop("_salt")
    for k in keys:
        right = right.withColumnRenamed(k, "_w" + k)
    on = residual
    for k in keys:
        on = (F.col(k) == F.col("_w" + k)) & on
    return left.join(right, on, how).drop("_salt")


def layer_cell_size(df: DataFrame, minx, miny, maxx, maxy, floor: float) -> float:
    """One cell size for a layer of boxes: the smallest power of two that is at
    least three quarters of the median extent and of ``floor`` and with which the boxes' cells are at
    most CELLS_PER_WINDOW a box on average plus CELLS_FLOOR. One aggregate."""
    boxes = df.select((_c(maxx) - _c(minx)).alias("w"), (_c(maxy) - _c(miny)).alias("h"))
    steps = [2.0 ** k for k in range(-20, 41)]
    cells = [F.expr(f"sum((w / {s!r}D + 2) * (h / {s!r}D + 2))") for s in steps]
    median, n, *sums = boxes.agg(F.expr("percentile_approx(greatest(w, h), 0.5D, 1000)"), F.count(F.lit(1)), *cells).first()
    least = max(float(median or 0.0), floor)
    return next((s for s, c in zip(steps, sums) if s >= least * 0.75 and (c or 0) <= CELLS_PER_WINDOW * n + CELLS_FLOOR), steps[-1])
