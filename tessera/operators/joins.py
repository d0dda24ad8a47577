"""Spatial joins as cell equi-joins with an exact residual.

Joins are inner, or (``how``) ``left_semi`` and ``left_anti``: the points in some
window, or in none, without any columns of windows. Points are the big side:
they are read once and never replicated. Windows (circles, lines,
polygons) have one row per cell they can match in, with only the segments that
matter there, so a (window, point) pair arises at most once and nothing has to
be collapsed. Windows are features: two of them stay two, whatever attributes
they share; ``_wid`` numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from . import cells as C

#: Segments of a window's cell that are plain columns; further ones are an array.
FLAT = 6
#: Heights of a cell (see polygon_cells) that are plain columns.
FLAT_UPS = 2
#: A block's side, in cells of its layer.
BLOCK = 4.0


def _renamed(left: DataFrame, right: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename right columns that collide with left ones."""
    mapping = {c: (prefix + c if c in left.columns else c) for c in right.columns}
    for old, new in mapping.items():
        if old != new:
            right = right.withColumnRenamed(old, new)
    return right, mapping


def circles_bytes(windows: DataFrame, copies: int = 9) -> int:
    """About the bytes of circles in memory, with a row for each of their cells."""
    return copies * (C.measured(windows)[0] + 72)


def distance_join(points: DataFrame, windows: DataFrame, radius: float, *,
                  point_xy=("x", "y"), window_xy=("x", "y"), inclusive: bool = True,
                  cell_size: float | None = None, right_prefix: str = "w_",
                  band: dict | None = None, with_distance: bool = True, how: str = "inner", celled: bool = False,
                  **join_opts) -> DataFrame:
    """Pairs (point, window) with planar distance ≤ radius (``< radius`` when
    ``inclusive=False``).

    ``band`` adds a range predicate on a second dimension folded into the
    equi-key, e.g. time: ``dict(point_col='sys_ms', lo='lo_ms', hi='hi_ms',
    bucket=864000000)`` keeps pairs with lo ≤ point_col ≤ hi (both window
    columns). Window columns that clash with point columns get
    ``right_prefix``. A point with a null coordinate is near no window. ``celled``:
    the points come with their cells (_cx, _cy) of that size.
    """
    size = float(cell_size or radius)
    if size < radius:
        raise ValueError("cell_size must be >= radius")
    windows, mapping = _renamed(points, windows, right_prefix)
    wx, wy = mapping[window_xy[0]], mapping[window_xy[1]]
    px, py = point_xy
    left = points if celled else C.with_point_cell(points, px, py, size)
    right = C.explode_disc_cells(windows, wx, wy, radius, size)
    keys, copies = ["_cx", "_cy"], 9
    if band:
        b = float(band["bucket"])
        left = left.withColumn("_cb", F.floor(F.col(band["point_col"]) / F.lit(b)).cast("long"))
        lo, hi = mapping[band["lo"]], mapping[band["hi"]]
        right = C.explode_range(right, F.floor(F.col(lo) / F.lit(b)), F.floor(F.col(hi) / F.lit(b)), "_cb")
        keys.append("_cb")
        widest = windows.agg(F.max(F.floor(F.col(hi) / F.lit(b)) - F.floor(F.col(lo) / F.lit(b)))).first()[0]
        copies *= int(widest or 0) + 1
    dx = F.col(px) - F.col(wx)
    dy = F.col(py) - F.col(wy)
    # cheap box test first, then the exact distance
    box = (F.abs(dx) <= F.lit(radius)) & (F.abs(dy) <= F.lit(radius))
    dist = G.planar_distance(px, py, wx, wy)
    cond = box & ((dist <= F.lit(radius)) if inclusive else (dist < F.lit(radius)))
    if band:
        t = F.col(band["point_col"])
        cond = cond & (t >= F.col(mapping[band["lo"]])) & (t <= F.col(mapping[band["hi"]]))
    joined = C.cell_join(left, right, keys, right_bytes=circles_bytes(windows, copies), how=how, residual=cond, salt_cols=list(points.columns), **join_opts)
    if how != "inner":
        return joined.select(*points.columns)
    out = joined.filter(cond).drop(*keys)
    if with_distance:
        out = out.withColumn("distance", dist)
    return out


# ---- windows with segments -----------------------------------------------------------

def numbered(windows: DataFrame, geom_col: str = "geom", tag: str = "windows", closed: bool = False) -> DataFrame:
    """The window layer as a written table with ``_wid``, a number per feature,
    and its segments (``closed``: of closed rings) in place of the geometry."""
    rest = [c for c in windows.columns if c != geom_col]
    segs = windows.select(*rest, F.expr(G.segments_sql(G.q(geom_col), closed)).alias("_segs"))
    return C.written(segs.withColumn("_wid", F.monotonically_increasing_id()), tag)


def _segment_rows(layer: DataFrame) -> DataFrame:
    """_wid, the segment's ends x1, y1, x2, y2 and its box."""
    s = layer.select("_wid", F.explode("_segs").alias("_s")).select("_wid", "_s.x1", "_s.y1", "_s.x2", "_s.y2")
    s = s.filter("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    return s.withColumns({"_minx": F.least("x1", "x2"), "_miny": F.least("y1", "y2"), "_maxx": F.greatest("x1", "x2"), "_maxy": F.greatest("y1", "y2")})


def _flat(cells: DataFrame, most: int, segs: str = "_list") -> tuple[DataFrame, bool, int]:
    """Segments as up to FLAT plain columns and an array of the rest; whether any
    row has a rest, and how many columns are used. ``most``: segments of a row."""
    used = max(1, min(FLAT, most))
    out = cells.withColumns({f"_e{i}": F.get(F.col(segs), F.lit(i)) for i in range(used)})
    out = out.withColumn("_more", F.when(F.size(segs) > FLAT, F.slice(segs, FLAT + 1, F.greatest(F.size(segs) - FLAT, F.lit(1)))))
    return out.drop(segs), most > FLAT, used


def line_cell_size(layer: DataFrame, radius: float) -> float:
    """The cell size of a layer of lines: by its segments, at least the radius."""
    return C.layer_cell_size(_segment_rows(layer), "_minx", "_miny", "_maxx", "_maxy", floor=float(radius))


def line_cells(layer: DataFrame, radius: float, size: float) -> DataFrame:
    """One row per line and cell of its segments' r-expanded boxes: _wid, _cx, _cy, _list (the
    segments that reach the cell: start, vector, its squared length) and their box _bx0, _by0, _bx1, _by1."""
    segs, r = _segment_rows(layer), F.lit(float(radius))
    reach = (F.col("_minx") - r, F.col("_miny") - r, F.col("_maxx") + r, F.col("_maxy") + r)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    l2 = dx * dx + dy * dy
    one = F.struct(F.col("x1"), F.col("y1"), dx.alias("dx"), dy.alias("dy"), F.when(l2 == 0, F.lit(1.0)).otherwise(l2).alias("l2"))
    return (C.explode_bbox_cells(segs.select("*", one.alias("_one")), *reach, size).groupBy("_wid", "_cx", "_cy")
            .agg(F.collect_list("_one").alias("_list"), F.min(reach[0]).alias("_bx0"), F.min(reach[1]).alias("_by0"), F.max(reach[2]).alias("_bx1"), F.max(reach[3]).alias("_by1")))


def line_buffer_join(points: DataFrame, lines: DataFrame, radius: float, *,
                     point_xy=("x", "y"), id_col: str = "id", geom_col: str = "geom",
                     strict: bool = True, cell_size: float | None = None, layer: DataFrame | None = None,
                     how: str = "inner", blocks: list[str] | None = None, copies: str | None = None, **join_opts) -> DataFrame:
    """Pairs (line, point) with the point inside the r-buffer of the line.

    ``strict`` (``ST_Within(point, ST_Buffer(line, r))``) keeps distance < r.
    Each line has one row per cell of its segments' r-expanded boxes, with the
    segments that reach that cell, so a point meets a line once. Two lines with
    one id are two lines. Returns the point columns, ``id_col``, ``_wid`` (the
    line's number in ``layer``, see ``numbered``) and ``distance``. With ``blocks``
    the same pairs arise by blocks, in Arrow batches (``pairs``), for layers that have
    very many; it names the columns that come out, other columns of ``layer`` too,
    and ``copies`` a column of ``layer`` with how often a line's pairs come. Options
    of the cell join play no part there.
    """
    if id_col in points.columns:
        raise ValueError(f"points already have a column named {id_col!r}")
    px, py = point_xy
    layer = layer if layer is not None else numbered(lines.select(id_col, geom_col), geom_col, "lines")
    if blocks is not None:
        if how != "inner":
            raise ValueError("blocks are for inner joins")
        from . import counts, pairs  # they import this module

        side = counts._block(float(cell_size) if cell_size is not None else BLOCK * line_cell_size(layer, radius))
        wanted = [c for c in layer.columns if c in [*blocks, copies] and c != "_wid"]
        cells = C.written(line_cells(layer, radius, side).join(layer.select("_wid", *wanted), "_wid"), "line-blocks")
        return pairs.window_pairs(points, cells, counts.Line(float(radius), strict), side, blocks, point_xy, copies)
    # about the size of a segment, at least r: fewer candidates than cells as large as the expanded boxes
    size = float(cell_size) if cell_size is not None else line_cell_size(layer, radius)
    cells = C.written(line_cells(layer, radius, size).join(layer.select("_wid", id_col), "_wid"), "line-cells")
    bytes_, most = C.measured(cells, "_list")
    right, more, used = _flat(cells, most)
    x, y = F.col(px), F.col(py)
    box = (x >= F.col("_bx0")) & (x <= F.col("_bx1")) & (y >= F.col("_by0")) & (y <= F.col("_by1"))
    parts = [G.vector_d2_sql(G.q(px), G.q(py), f"_e{i}") for i in range(used)]
    if more:
        parts.append(f"array_min(transform(_more, s -> {G.vector_d2_sql(G.q(px), G.q(py), 's')}))")
    d2 = F.expr(f"least({', '.join(parts)})" if len(parts) > 1 else parts[0])  # least skips nulls
    r2 = F.lit(float(radius) * float(radius))
    joined = C.cell_join(C.with_point_cell(points, px, py, size), right, ["_cx", "_cy"], right_bytes=bytes_, how=how, residual=box & ((d2 < r2) if strict else (d2 <= r2)),
                         salt_cols=list(points.columns), **join_opts)
    if how != "inner":
        return joined.select(*points.columns)
    near = joined.filter(box).withColumn("_d2", d2)
    near = near.filter((F.col("_d2") < r2) if strict else (F.col("_d2") <= r2))
    return near.select(*points.columns, id_col, "_wid", F.sqrt("_d2").alias("distance"))


def edge_touches(layer: DataFrame, size: float) -> DataFrame:
    """One row per edge of a polygon and cell that it touches: _wid, _cx, _cy, the edge's
    ends, _c0 (the first cell that it touches in this row of cells), _top (1 if it passes
    the row's upper line) and _u1, _u2 (the height of an end that lies in this row, in a
    cell further right).

    An edge goes through a row of cells in one range of x, found by cutting it at
    the row's lines; the range is widened by the rounding of that cut.
    """
    rows = C.explode_range(_segment_rows(layer), C.cell_index("_miny", size), C.cell_index("_maxy", size), "_cy")
    rising = F.col("y1") <= F.col("y2")
    lx, hx = F.when(rising, F.col("x1")).otherwise(F.col("x2")), F.when(rising, F.col("x2")).otherwise(F.col("x1"))
    low, high = F.col("_cy") * F.lit(float(size)), (F.col("_cy") + 1) * F.lit(float(size))
    bottom, top = F.greatest(F.col("_miny"), low - F.abs(low) * 1e-15), F.least(F.col("_maxy"), high + F.abs(high) * 1e-15)
    height = F.col("_maxy") - F.col("_miny")
    at = lambda y: lx + (y - F.col("_miny")) / height * (hx - lx)
    a, b = F.when(height == 0, F.col("_minx")).otherwise(at(bottom)), F.when(height == 0, F.col("_maxx")).otherwise(at(top))
    slack = (F.abs("x1") + F.abs("x2")) * 1e-14
    first = C.cell_index(F.greatest(F.col("_minx"), F.least(a, b)) - slack, size)
    last = C.cell_index(F.least(F.col("_maxx"), F.greatest(a, b)) + slack, size)
    rows = rows.withColumns({"_c0": first, "_c1": last, "_r1": C.cell_index("y1", size), "_r2": C.cell_index("y2", size)})
    cells = C.explode_range(rows, F.col("_c0"), F.col("_c1"), "_cx")
    over = (F.col("_r1") > F.col("_cy")) != (F.col("_r2") > F.col("_cy"))
    up = lambda i: F.when((F.col(f"_r{i}") == F.col("_cy")) & (C.cell_index(f"x{i}", size) > F.col("_cx")), F.col(f"y{i}"))
    return cells.select("_wid", "_cx", "_cy", "x1", "y1", "x2", "y2", "_c0", F.when(over, 1).otherwise(0).alias("_top"), up(1).alias("_u1"), up(2).alias("_u2"))


#: Heights are paired off where a cell has at most so many; more are kept as they are, to the same effect.
PAIRED = 64


def polygon_cells(layer: DataFrame, size: float) -> DataFrame:
    """One row per polygon and cell that can hold inner points: _wid, _cx, _cy,
    _par, _list (edges that touch the cell) and _ups (heights).

    The even-odd test counts the edges to the right of a point. Those that touch
    the point's cell are tested one by one. Of the others in the cell's row only
    those to the right count, and their number's parity is that of

    * _par: those that pass the row's upper line, and
    * _ups above the point: the ends of touching edges that lie in the row, right
      of the cell. (At an end that lies there an even number of edges of closed
      rings meets, each of which either touches the cell or lies to its right.)

    So an edge goes only to cells that it touches, and _par is carried along a row
    of cells by a running sum over the edges' first cells. Cells between two touched
    ones are wholly inside or outside by the same sum; inner ones get a row without
    edges. There are as many rows as touched cells and inner cells, however wide an outline is.
    """
    touched = (edge_touches(layer, size).repartition("_wid", "_cy").groupBy("_wid", "_cy", "_cx")
               .agg((F.sum(F.when(F.col("_cx") == F.col("_c0"), F.col("_top"))) % 2).alias("_here"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_list"),
                    F.array_sort(F.concat(F.collect_list("_u1"), F.collect_list("_u2"))).alias("_all")))
    paired = "aggregate(_all, CAST(array() AS array<double>), (a, u) -> IF(size(a) > 0 AND get(a, size(a) - 1) = u, slice(a, 1, size(a) - 1), concat(a, array(u))))"
    right = Window.partitionBy("_wid", "_cy").orderBy(F.col("_cx").desc())
    before = F.coalesce(F.sum(F.coalesce("_here", F.lit(0))).over(right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = touched.select("_wid", "_cy", F.col("_cx").alias("_at"), "_list", F.expr(f"IF(size(_all) <= {PAIRED}, {paired}, _all)").alias("_ups"),
                           (before % 2).cast("int").alias("_right"), ((before + F.coalesce("_here", F.lit(0))) % 2).cast("int").alias("_run"), F.lead("_cx").over(right).alias("_next"))
    begin = F.when((F.col("_run") == 1) & F.col("_next").isNotNull(), F.col("_next") + 1).otherwise(F.col("_at"))
    cells = C.explode_range(cells.withColumn("_begin", begin), F.col("_begin"), F.col("_at"), "_cx")
    own = F.col("_cx") == F.col("_at")
    return cells.select("_wid", "_cx", "_cy", F.when(own, F.col("_right")).otherwise(1).alias("_par"), F.when(own, F.col("_list")).otherwise(F.array()).alias("_list"),
                        F.when(own, F.col("_ups")).otherwise(F.array()).alias("_ups"))


def polygon_boxes(layer: DataFrame) -> DataFrame:
    """_wid and the box _x0, _y0, _x1, _y1 of each polygon."""
    v = F.col("_segs")
    return layer.select("_wid", F.array_min(F.transform(v, lambda s: F.least(s["x1"], s["x2"]))).alias("_x0"), F.array_min(F.transform(v, lambda s: F.least(s["y1"], s["y2"]))).alias("_y0"),
                        F.array_max(F.transform(v, lambda s: F.greatest(s["x1"], s["x2"]))).alias("_x1"), F.array_max(F.transform(v, lambda s: F.greatest(s["y1"], s["y2"]))).alias("_y1"))


def polygon_join(points: DataFrame, polygons: DataFrame, *, point_xy=("x", "y"),
                 geom_col: str = "geom", boundary: bool = False,
                 cell_size: float | None = None, right_prefix: str = "w_", layer: DataFrame | None = None,
                 how: str = "inner", blocks: list[str] | None = None, **join_opts) -> DataFrame:
    """Pairs (polygon, point) with the point inside the polygon.

    ``boundary=False`` is ``ST_Within`` (interior only). A point inside two
    polygons appears twice (row semantics of the SQL join). Rings are closed, a
    ``layer`` must have been numbered so. Returns the point columns, the
    polygons' columns but the geometry, and ``_wid``; with ``blocks`` as in
    ``line_buffer_join``.
    """
    px, py = point_xy
    if layer is None:
        renamed, mapping = _renamed(points, polygons, right_prefix)
        layer = numbered(renamed, mapping[geom_col], "polygons", closed=True)
    rest = [c for c in layer.columns if c != "_segs"]
    if blocks is not None:
        if how != "inner":
            raise ValueError("blocks are for inner joins")
        from . import counts, pairs  # they import this module

        boxes = polygon_boxes(layer)
        side = counts._block(float(cell_size) if cell_size is not None else BLOCK * C.layer_cell_size(boxes, "_x0", "_y0", "_x1", "_y1", floor=1e-9))
        wanted = [c for c in rest if c in blocks and c != "_wid"]
        cells = C.written(polygon_cells(layer, side).join(boxes, "_wid").join(layer.select("_wid", *wanted), "_wid"), "polygon-blocks")
        return pairs.window_pairs(points, cells, counts.Polygon(boundary), side, blocks, point_xy)
    if cell_size is None:
        cell_size = C.layer_cell_size(polygon_boxes(layer), "_x0", "_y0", "_x1", "_y1", floor=1e-9)
    size = float(cell_size)
    cells = C.written(polygon_cells(layer, size).join(layer.select(*rest), "_wid"), "polygon-cells")
    bytes_, most, ups = C.measured(cells, "_list", "_ups")
    right, more, used = _flat(cells, most)
    for i in range(min(ups, FLAT_UPS)):
        right = right.withColumn(f"_u{i}", F.get("_ups", F.lit(i)))
    if ups > FLAT_UPS:
        right = right.withColumn("_ups", F.when(F.size("_ups") > FLAT_UPS, F.slice("_ups", FLAT_UPS + 1, F.greatest(F.size("_ups") - FLAT_UPS, F.lit(1)))))
    else:
        right = right.drop("_ups")
    x, y = G.q(px), G.q(py)
    cross = " + ".join([G.crosses_sql(x, y, f"_e{i}") for i in range(used)] + [f"IF(_u{i} > {y}, 1, 0)" for i in range(min(ups, FLAT_UPS))])
    if ups > FLAT_UPS:
        cross += f" + IF(_ups IS NULL, 0, size(filter(_ups, u -> u > {y})))"
    on = " OR ".join(G.on_edge_sql(x, y, f"_e{i}") for i in range(used))
    if more:
        cross += f" + aggregate(coalesce(_more, array()), 0, (a, s) -> a + {G.crosses_sql(x, y, 's')})"
        on += f" OR exists(coalesce(_more, array()), s -> {G.on_edge_sql(x, y, 's')})"
    odd = f"(_par + {cross}) % 2 = 1"
    inside = f"({odd}) OR ({on})" if boundary else f"({odd}) AND NOT ({on})"
    joined = C.cell_join(C.with_point_cell(points, px, py, size), right, ["_cx", "_cy"], right_bytes=bytes_, how=how, residual=F.expr(inside), salt_cols=list(points.columns), **join_opts)
    if how != "inner":
        return joined.select(*points.columns)
    return joined.filter(F.expr(inside)).select(*points.columns, *rest)


def regular_grid_join(points: DataFrame, *, point_xy=("x", "y"), x0: float, y0: float,
                      cell: float, nx: int, ny: int, strict_edges: bool = True) -> DataFrame:
    """Join-free fishnet: the cell of a point in a regular grid is closed form.

    Adds ``oid = row * nx + col``. With ``strict_edges`` a point exactly on a
    cell edge belongs to no cell (``ST_Within`` on the squares).
    """
    px, py = point_xy
    fx = (F.col(px) - F.lit(x0)) / F.lit(cell)
    fy = (F.col(py) - F.lit(y0)) / F.lit(cell)
    col = F.floor(fx).cast("long")
    row = F.floor(fy).cast("long")
    ok = (col >= 0) & (col < nx) & (row >= 0) & (row < ny)
    if strict_edges:
        ok = ok & (fx != col.cast("double")) & (fy != row.cast("double"))
    return points.withColumn("oid", row * F.lit(nx) + col).filter(ok)


def line_buffer_areas(layer: DataFrame, radius: float, steps: int = 32) -> DataFrame:
    """Area of each line's dissolved r-buffer: _wid, area.

    Horizontal scan lines ``radius / steps`` apart cut each segment's capsule
    in one interval; the union of a line's intervals, times the distance of
    scan lines, is the area (midpoint rule). With 32 steps the relative error
    is below 0.2 %, the largest being that of a point's disc.
    """
    r, h = float(radius), float(radius) / steps
    segs = _segment_rows(layer).select("_wid", "x1", "y1", "x2", "y2", "_miny", "_maxy")
    segs = segs.withColumn("_len", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    # the normal of length r
    segs = segs.withColumn("_nx", F.when(F.col("_len") > 0, -(F.col("y2") - F.col("y1")) / F.col("_len") * r).otherwise(0.0)) \
               .withColumn("_ny", F.when(F.col("_len") > 0, (F.col("x2") - F.col("x1")) / F.col("_len") * r).otherwise(0.0))
    block = 4096  # scan lines of a long segment are dealt in blocks, no array is longer
    lo, hi = F.floor((F.col("_miny") - r) / h), F.floor((F.col("_maxy") + r) / h)
    rows = C.explode_range(segs.withColumns({"_lo": lo, "_hi": hi}), F.floor(F.col("_lo") / block), F.floor(F.col("_hi") / block), "_b")
    rows = C.explode_range(rows, F.greatest("_lo", F.col("_b") * block), F.least("_hi", F.col("_b") * block + (block - 1)), "_k")
    y = (F.col("_k") + 0.5) * h
    ends, sides = [], []
    for ex, ey in (("x1", "y1"), ("x2", "y2")):
        d = y - F.col(ey)
        w = F.when(F.abs(d) <= r, F.sqrt(F.lit(r * r) - d * d))
        ends.append((F.col(ex) - w, F.col(ex) + w))
    for sign in (1.0, -1.0):
        ax, ay = F.col("x1") + F.col("_nx") * sign, F.col("y1") + F.col("_ny") * sign
        bx, by = F.col("x2") + F.col("_nx") * sign, F.col("y2") + F.col("_ny") * sign
        sides.append(F.when((ay > y) != (by > y), ax + (y - ay) / (by - ay) * (bx - ax)))
    left = F.least(*[a for a, _ in ends], *sides)
    right = F.greatest(*[b for _, b in ends], *sides)
    cut = rows.select("_wid", "_k", left.alias("_l"), right.alias("_r")).filter("_l IS NOT NULL")
    return _covered(cut, h)


def _covered(cut: DataFrame, h: float) -> DataFrame:
    before = Window.partitionBy("_wid", "_k").orderBy("_l", "_r").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_to", F.max("_r").over(before))
    new = F.greatest(F.lit(0.0), F.col("_r") - F.greatest(F.col("_l"), F.coalesce(F.col("_to"), F.col("_l"))))
    return own.groupBy("_wid").agg((F.sum(new) * F.lit(h)).alias("area"))
