"""Points per window counted without their pairs.

A count by window and date has one row for what a join has thousands of pairs. Points
and windows meet by blocks of the plane (``cells``), as in the joins, but in a cogroup:
there strips of finer cells part a block's points. Each segment marks, strip by strip, what
it may touch and what lies wholly inside, for many windows at once; a run of cells inside a
window counts as the difference of two running sums, and only the points that an outline
may touch are tested one by one, by the joins' own predicates. So the work of a window grows
with its outline, not with the points inside it, and what leaves a block is one row per window and date.

Equal points are one row with a number beforehand. A block with many points or many
windows is dealt in parts: counts of parts add up, nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as C
from . import joins as J

#: Points and windows of a block that meet in one task; more are dealt in parts.
POINTS_PART, WINDOWS_PART = 1 << 19, 1 << 14
#: Marks and points tested at once (about what a core's cache holds), and sums of a block.
MARKS, MATRIX, SUMS = 1 << 16, 1 << 15, 1 << 22


def _block(size: float) -> float:
    """A block's side from the least one: a power of two, which fine cells halve exactly."""
    return 2.0 ** int(np.ceil(np.log2(size)))


# ---- within a block -----------------------------------------------------------------

def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _list(t: pa.Table, name: str, fields: tuple[str, ...] = ()):
    """Offsets and values (a matrix of ``fields``, if given) of a list column."""
    a = t[name].combine_chunks()
    a = a if isinstance(a, pa.Array) else a.chunk(0)
    off, v = a.offsets.to_numpy().astype(np.int64), a.flatten()
    parts = [v.field(f) for f in fields] if fields else [v]
    m = [x.to_numpy(zero_copy_only=False).astype(float) for x in parts]
    return off - off[0], np.stack(m, axis=1) if fields else m[0]


class Grid:
    """A block's strips (rows) of columns, and the points sorted by them: equal cells are neighbours."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cx: int, cy: int, side: float):
        bits = np.log2(max(len(x), 1))
        self.rows = 1 << int(np.clip(round(bits / 2 - 1.5), 0, 9))
        self.columns = 1 << int(np.clip(np.ceil(bits - np.log2(self.rows)), 0, 12))
        self.x0, self.y0, self.high, self.wide = cx * side, cy * side, side / self.rows, side / self.columns
        column = np.clip(np.floor(x / self.wide) - float(cx) * self.columns, 0, self.columns - 1).astype(np.int64)
        row = np.clip(np.floor(y / self.high) - float(cy) * self.rows, 0, self.rows - 1).astype(np.int64)
        cell = row * self.columns + column
        self.order = np.argsort(cell, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.rows * self.columns))])
        self.reach = max(abs(self.x0), abs(self.y0), side)

    def strips(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First strip and number of strips of ranges of y."""
        a = np.clip(np.floor((low - self.y0) / self.high), 0, self.rows)
        return a.astype(np.int64), np.maximum(0, np.clip(np.floor((high - self.y0) / self.high) + 1, 0, self.rows) - a).astype(np.int64)

    def at(self, row: np.ndarray, x: np.ndarray, after: int) -> np.ndarray:
        """Number of the first point of x's cell, or (``after``: 1) of the cell after it."""
        return self.first[row * self.columns + np.clip(np.floor((x - self.x0) / self.wide) + after, 0, self.columns).astype(np.int64)]


def _marks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
    """Where ranges of points begin and end: group, number of the point, how many ranges near an outline
    are open from there on (more or fewer), and what that adds to those inside."""
    return np.r_[group, group], np.r_[lo, hi], np.r_[near, -near], np.r_[begin, end]


class Line:
    """The r-buffer of segments."""

    columns, parity = ("_list",), False

    def __init__(self, radius: float, strict: bool):
        self.r, self.strict = radius, strict

    def read(self, t: pa.Table) -> None:
        self.off, self.s = _list(t, "_list", ("x1", "y1", "dx", "dy", "l2"))

    def place(self, g: Grid) -> np.ndarray:
        """Slack, the strips of every segment, and the number of marks of every window."""
        s = self.s
        self.slack = 4e-12 * max(g.reach, self.r, np.abs(s[:, :4]).max(initial=0.0))
        low, high = np.minimum(s[:, 1], s[:, 1] + s[:, 3]), np.maximum(s[:, 1], s[:, 1] + s[:, 3])
        self.row, self.n = g.strips(low - self.r - self.slack, high + self.r + self.slack)
        return 4 * np.diff(np.concatenate([[0], np.cumsum(self.n)])[self.off])

    def _section(self, s, y):
        """Ends of the buffer of each segment at a height, NaN off it."""
        x1, y1, dx, dy, l2 = s.T
        long = np.sqrt(dx * dx + dy * dy)
        nx, ny = (np.where(long > 0, d / np.where(long > 0, long, 1.0) * self.r, 0.0) for d in (-dy, dx))
        lo, hi = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for ex, ey in ((x1, y1), (x1 + dx, y1 + dy)):
            w = np.sqrt(self.r * self.r - (y - ey) ** 2)
            lo, hi = np.fmin(lo, ex - w), np.fmax(hi, ex + w)
        for sign in (1.0, -1.0):
            t = (y - (y1 + sign * ny)) / dy
            x = np.where((t >= 0) & (t <= 1), x1 + sign * nx + t * dx, np.nan)
            lo, hi = np.fmin(lo, x), np.fmax(hi, x)
        return lo, hi

    def marks(self, g: Grid, i: int, j: int):
        """Of each segment and strip what it may reach and what lies wholly within it (the buffer is convex:
        what does so at the strip's both edges). The strip is widened by the slack, which covers all rounding."""
        a, b = self.off[i], self.off[j]
        at = np.repeat(np.arange(a, b), self.n[a:b])
        row = _gathered(self.row[a:b], self.n[a:b])
        window = np.repeat(np.arange(i, j), np.diff(self.off[i:j + 1]))[at - a]
        s, e = self.s[at], self.slack
        y0, y1 = g.y0 + row * g.high - e, g.y0 + (row + 1) * g.high + e
        x2, y2 = s[:, 0] + s[:, 2], s[:, 1] + s[:, 3]
        bottom, top = np.minimum(s[:, 1], y2) - self.r, np.maximum(s[:, 1], y2) + self.r
        with np.errstate(all="ignore"):
            # sections only grow from the lowest and the highest point inwards: a step within them is the wider one
            (l0, h0), (l1, h1) = (self._section(s, np.clip(y, bottom + e / 4, top - e / 4)) for y in (y0, y1))
        lo, hi = np.fmin(l0, l1), np.fmax(h0, h1)
        for ex, ey in ((s[:, 0], s[:, 1]), (x2, y2)):  # the ends' discs reach furthest at the ends' height
            met = (ey >= y0) & (ey <= y1)
            lo, hi = np.where(met, np.fmin(lo, ex - self.r), lo), np.where(met, np.fmax(hi, ex + self.r), hi)
        # a section that rounding lost: the segment's whole width
        lo, hi = np.where(np.isnan(l0 + l1), np.minimum(s[:, 0], x2) - self.r, lo), np.where(np.isnan(l0 + l1), np.maximum(s[:, 0], x2) + self.r, hi)
        inner0, inner1 = np.maximum(l0, l1) + e, np.minimum(h0, h1) - e
        group = window * g.rows + row
        most = g.at(row, lo - e, 0), g.at(row, hi + e, 1)
        full = np.flatnonzero((y0 > bottom) & (y1 < top) & (inner0 < inner1))
        least = g.at(row[full], inner0[full], 1), g.at(row[full], inner1[full], 0)
        full, least = full[least[0] < least[1]], [x[least[0] < least[1]] for x in least]
        one = np.ones(len(group), np.int64)
        marks = _marks(group, *most, one, 0 * one, 0 * one), _marks(group[full], *least, 0 * one[full], one[full], -one[full])
        return [np.concatenate(x) for x in zip(*marks, strict=True)]

    def distances(self, window, x, y) -> np.ndarray:
        """Squared distances of points to the nearest segment of their windows, as ``vector_d2_sql`` has them."""
        best, size = np.full(len(x), np.inf), np.diff(self.off)[window]
        start, fields = self.off[window], np.ascontiguousarray(self.s.T)
        for k in range(int(size.max(initial=0))):
            on = slice(None) if k < size.min() else np.flatnonzero(size > k)
            of, u, v = start[on] + k, x[on], y[on]
            x1, y1, dx, dy, l2 = (c[of] for c in fields)
            t = np.maximum(0.0, np.minimum(1.0, ((u - x1) * dx + (v - y1) * dy) / l2))
            ex, ey = u - (x1 + t * dx), v - (y1 + t * dy)
            best[on] = np.minimum(best[on], ex * ex + ey * ey)
        return best

    def holds(self, window, x, y):
        d2 = self.distances(window, x, y)
        return d2 < self.r * self.r if self.strict else d2 <= self.r * self.r


class Circle(Line):
    """A disc of a radius, its edge included or not: the buffer of a segment without length."""

    columns = ("_x", "_y")

    def read(self, t: pa.Table) -> None:
        x, y = t["_x"].to_numpy(), t["_y"].to_numpy()
        self.off, self.s = np.arange(len(x) + 1), np.stack([x, y, 0 * x, 0 * x, np.ones(len(x))], axis=1)

    def holds(self, window, x, y):
        dx, dy = x - self.s[window, 0], y - self.s[window, 1]
        d = np.sqrt(dx * dx + dy * dy)
        return d < self.r if self.strict else d <= self.r


class Polygon:
    """The even-odd inside of a polygon by its part in a block (``joins.polygon_cells``)."""

    columns, parity = ("_par", "_list", "_ups", "_y0", "_y1"), True

    def __init__(self, boundary: bool):
        self.boundary = boundary

    def read(self, t: pa.Table) -> None:
        self.par, self.y0, self.y1 = (t[c].to_numpy() for c in ("_par", "_y0", "_y1"))
        self.off, self.e = _list(t, "_list", ("x1", "y1", "x2", "y2"))
        self.up, self.ups = _list(t, "_ups")

    def place(self, g: Grid) -> np.ndarray:
        """Slack, the strips of every polygon and edge, and the number of marks of every window."""
        e = self.e
        self.slack = 4e-12 * max(g.reach, np.abs(e).max(initial=0.0))
        self.row, self.n = g.strips(self.y0 - self.slack, self.y1 + self.slack)
        self.edge_row, self.edge_n = g.strips(np.minimum(e[:, 1], e[:, 3]) - self.slack, np.maximum(e[:, 1], e[:, 3]) + self.slack)
        return 2 * self.n + 2 * np.diff(np.concatenate([[0], np.cumsum(self.edge_n)])[self.off]) + np.diff(self.up) * self.n

    def marks(self, g: Grid, i: int, j: int):
        """Of each edge and strip what it may touch, and where the number of edges to the right changes."""
        a, b = self.off[i], self.off[j]
        at = np.repeat(np.arange(a, b), self.edge_n[a:b])
        row = _gathered(self.edge_row[a:b], self.edge_n[a:b])
        window = np.repeat(np.arange(i, j), np.diff(self.off[i:j + 1]))[at - a]
        x1, y1, x2, y2 = self.e[at].T
        low, high, middle = g.y0 + row * g.high - self.slack, g.y0 + (row + 1) * g.high + self.slack, g.y0 + (row + 0.5) * g.high
        with np.errstate(all="ignore"):
            p, q = (x1 + np.clip((y - y1) / (y2 - y1), 0, 1) * (x2 - x1) for y in (low, high))
        p, q = np.where(y1 == y2, x1, p), np.where(y1 == y2, x2, q)
        over = ((y1 > middle) != (y2 > middle)).astype(np.int64)
        group = window * g.rows + row
        near = _marks(group, g.at(row, np.minimum(p, q) - self.slack, 0), g.at(row, np.maximum(p, q) + self.slack, 1), np.ones(len(group), np.int64), 0 * over, -over)
        # a strip begins with the edges to the right of it, those that do not touch the block included
        rows, windows = _gathered(self.row[i:j], self.n[i:j]), np.repeat(np.arange(i, j), self.n[i:j])
        begin = windows * g.rows + rows
        size = np.diff(self.up)[windows]
        higher = self.ups[_gathered(self.up[windows], size)] > np.repeat(g.y0 + (rows + 0.5) * g.high, size)
        rest = self.par[windows] + np.bincount(np.repeat(np.arange(len(begin)), size)[higher], minlength=len(begin))
        met, place = np.zeros(len(begin), np.int64), np.searchsorted(begin, group)
        np.add.at(met, place[over > 0], 1)
        whole = (begin, g.first[rows * g.columns], 0 * met, rest + met), (begin, g.first[(rows + 1) * g.columns], 0 * met, -rest)
        return [np.concatenate(x) for x in zip(near, *whole, strict=True)]

    def holds(self, window, x, y):
        n, on = self.par[window].astype(np.int64), np.zeros(len(x), dtype=bool)
        fields = np.ascontiguousarray(self.e.T)
        low, high = np.minimum(fields[1], fields[3]), np.maximum(fields[1], fields[3])
        for off, size, is_edge in ((self.up, np.diff(self.up)[window], False), (self.off, np.diff(self.off)[window], True)):
            start = off[window]
            for k in range(int(size.max(initial=0))):
                some = slice(None) if k < size.min() else np.flatnonzero(size > k)
                of, v = start[some] + k, y[some]
                if not is_edge:
                    n[some] += self.ups[of] > v
                    continue
                met = np.flatnonzero((low[of] <= v) & (v <= high[of]))  # others are neither crossed nor touched
                of, v, some = of[met], v[met], met if isinstance(some, slice) else some[met]
                u = x[some]
                x1, y1, x2, y2 = (c[of] for c in fields)
                dx, dy = x2 - x1, y2 - y1
                rise = dx * (v - y1)
                with np.errstate(all="ignore"):
                    n[some] += ((y1 > v) != (y2 > v)) & (u < rise / dy + x1)
                line = (u - x1) * dy == rise
                if line.any():
                    on[some] |= line & (u >= np.minimum(x1, x2)) & (u <= np.maximum(x1, x2))
        return n % 2 == 1 if not on.any() else (n % 2 == 1) | on if self.boundary else (n % 2 == 1) & ~on


def _batches(sizes: np.ndarray, most: int):
    """Neighbours whose sizes add up to about ``most``."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _ranges(kind, grid: Grid, i: int, j: int, points: int) -> tuple:
    """Ranges of the sorted points (first, one after the last, window) that the outlines of windows i to j may touch, and
    those wholly inside. A point is in one range of a window at most."""
    at, point, near, whole = kind.marks(grid, i, j)
    order = np.argsort(at * (points + 1) + point, kind="stable")
    at, point, near, whole = at[order], point[order], np.cumsum(near[order]), np.cumsum(whole[order])
    a, b, window = point[:-1], point[1:], at[:-1] // grid.rows
    some = (at[1:] == at[:-1]) & (a < b)
    full = (near[:-1] == 0) & (whole[:-1] % 2 == 1) if kind.parity else whole[:-1] > 0
    tested, full = some & ~full & (near[:-1] > 0), some & full
    return (a[tested], b[tested], window[tested]), (a[full], b[full], window[full])


def _counted(kind, side: float, by: str | None, names: list[str]):
    """The cogroup's function: points and windows of a block's part to (_wid, ``by``, n)."""

    def run(key, points: pa.Table, windows: pa.Table) -> pa.Table:
        x, y, n = points["_px"].to_numpy(), points["_py"].to_numpy(), points["_n"].to_numpy()
        group, labels = np.zeros(len(x), dtype=np.int64), None
        if by is not None:
            coded = pc.dictionary_encode(points[by].combine_chunks(), null_encoding="encode")
            coded = coded if isinstance(coded, pa.Array) else coded.chunk(0)
            group, labels = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        kinds = len(labels) if by is not None else 1
        wid, out = windows["_wid"].to_numpy(), []
        if len(x) and len(wid):
            grid = Grid(x, y, key[0].as_py(), key[1].as_py(), side)
            x, y, n, group = (v[grid.order] for v in (x, y, n, group))
            # running sums of every ``step`` points, exact: whole numbers below 2^53
            step = -(-len(x) * kinds // SUMS)
            slots = len(x) // step
            sums = np.zeros((slots + 1, kinds))
            sums[1:] = np.cumsum(np.bincount(np.arange(slots * step) // step * kinds + group[:slots * step], weights=n[:slots * step], minlength=slots * kinds).reshape(slots, kinds), axis=0)
            kind.read(windows)
            for i, j in _batches(np.maximum(kind.place(grid), kinds), MARKS):
                found = np.zeros((j - i) * kinds)
                (a, b, window), of_full = _ranges(kind, grid, i, j, len(x))
                pieces = [(a, b, window, True)]
                a, b, window = of_full
                first, last = -(-a // step), b // step
                if step > 1:  # what running sums leave at both ends
                    pieces += [(a, np.minimum(b, first * step), window, False), (np.maximum(last * step, np.minimum(b, first * step)), b, window, False)]
                first, last, window = (v[first < last] for v in (first, last, window))
                for c, d in _batches(np.full(len(first), kinds), SUMS):
                    head = np.flatnonzero(np.r_[True, window[c + 1:d] != window[c:d - 1]])
                    total = np.add.reduceat(sums[last[c:d]] - sums[first[c:d]], head, axis=0)
                    found.reshape(-1, kinds)[window[c:d][head] - i] += total
                for a, b, window, test in pieces:
                    for c, d in _batches(b - a, MATRIX):
                        size = b[c:d] - a[c:d]
                        own, of = _gathered(a[c:d], size), np.repeat(window[c:d], size)
                        if test:
                            kept = kind.holds(of, x[own], y[own])
                            own, of = own[kept], of[kept]
                        found += np.bincount((of - i) * kinds + group[own], weights=n[own], minlength=len(found))
                some = found.nonzero()[0]
                out.append((wid[i + some // kinds], some % kinds, found[some]))
        w, g, m = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        found = {"_wid": pa.array(w.astype(np.int64)), "n": pa.array(m.astype(np.int64))}
        if by is not None:
            found[by] = labels.take(pa.array(g.astype(np.int64))).cast(pa.string())
        return pa.table({c: found[c] for c in names})

    return run


# ---- blocks -----------------------------------------------------------------------------

def _parts(df: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks with more than ``most`` rows and in how many parts they go; at most rows / most of them."""
    n = df.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    return F.broadcast(n.select("_cx", "_cy", F.ceil(F.col("_rows") / F.lit(most)).cast("int").alias(name)))


def window_counts(points: DataFrame, cells: DataFrame, kind, side: float, by: str | None = None, point_xy=("x", "y")) -> DataFrame:
    """Points per window: _wid, ``by`` (a text column of the points, if given), n; windows with a match only.

    ``cells``: a written table with one row per window and block (_wid, _cx, _cy and the columns of ``kind``).
    """
    px, py = point_xy
    keys = [by] if by is not None else []
    raw = points.select(F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py"), *keys).filter("_px IS NOT NULL AND _py IS NOT NULL")
    pts = C.with_point_cell(raw.groupBy("_px", "_py", *keys).agg(F.count(F.lit(1)).alias("_n")), "_px", "_py", side)
    many, wide = _parts(C.with_point_cell(raw, "_px", "_py", side), POINTS_PART, "_pp"), _parts(cells, WINDOWS_PART, "_wp")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    own = lambda c, *of: F.pmod(F.xxhash64(*of), F.coalesce(F.col(c), F.lit(1))).cast("int")
    dealt = lambda df: df.join(many, ["_cx", "_cy"], "left").join(wide, ["_cx", "_cy"], "left")
    p = dealt(pts).withColumn("_p", own("_pp", "_px", "_py", *keys)).withColumn("_w", every("_wp")).drop("_pp", "_wp")
    w = dealt(cells.select("_wid", "_cx", "_cy", *kind.columns)).withColumn("_w", own("_wp", "_wid")).withColumn("_p", every("_pp")).drop("_pp", "_wp")
    at = ["_cx", "_cy", "_p", "_w"]
    names = ["_wid", *keys, "n"]
    schema = ", ".join(f"{c} {'string' if c in keys else 'long'}" for c in names)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    found = p.repartition(n, *at).groupBy(*at).cogroup(w.repartition(n, *at).groupBy(*at)).applyInArrow(_counted(kind, side, by, names), schema)
    # dealt by window alone: the join with the layer needs no further shuffle
    return found.repartition(n, "_wid").groupBy("_wid", *keys).agg(F.sum("n").alias("n"))


def distance_counts(points: DataFrame, windows: DataFrame, radius: float, *, by: str | None = None, point_xy=("x", "y"),
                    window_xy=("x", "y"), inclusive: bool = True) -> DataFrame:
    """``joins.distance_join`` counted: the windows' columns, ``by`` and n, windows that share a place apart."""
    wx, wy = window_xy
    layer = C.written(windows.withColumn("_wid", F.monotonically_increasing_id()), "circles")
    side = _block(2.0 * radius)
    centres = layer.select("_wid", F.col(wx).cast("double").alias("_x"), F.col(wy).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    found = window_counts(points, C.explode_disc_cells(centres, "_x", "_y", float(radius), side), Circle(float(radius), not inclusive), side, by, point_xy)
    return with_windows(found, layer)


def line_buffer_counts(points: DataFrame, layer: DataFrame, radius: float, *, by: str | None = None, point_xy=("x", "y"), strict: bool = True) -> DataFrame:
    """``joins.line_buffer_join`` counted: the columns of ``layer`` (see ``joins.numbered``) but the segments, ``by`` and n."""
    side = _block(8.0 * J.line_cell_size(layer, radius))
    return with_windows(window_counts(points, C.written(J.line_cells(layer, radius, side), "line-blocks"), Line(float(radius), strict), side, by, point_xy), layer.drop("_segs"))


def polygon_counts(points: DataFrame, layer: DataFrame, *, by: str | None = None, point_xy=("x", "y"), boundary: bool = False) -> DataFrame:
    """``joins.polygon_join`` counted: the columns of ``layer`` (numbered, closed) but the segments, ``by`` and n."""
    boxes = J.polygon_boxes(layer)
    side = _block(4.0 * C.layer_cell_size(boxes, "_x0", "_y0", "_x1", "_y1", floor=1e-9))
    cells = C.written(J.polygon_cells(layer, side).join(boxes, "_wid"), "polygon-blocks")
    return with_windows(window_counts(points, cells, Polygon(boundary), side, by, point_xy), layer.drop("_segs"))


def with_windows(found: DataFrame, layer: DataFrame) -> DataFrame:
    """Counts with their windows' columns; the layer is broadcast if it is small."""
    return C.cell_join(found, layer, ["_wid"], right_bytes=C.measured(layer)[0])
