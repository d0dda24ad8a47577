"""Aggregations and the join-result reports (modes 1-6).

All are ``groupBy`` plans with partial (map-side) aggregation, so a hot group
is reduced to one row per task before the shuffle. No report collects an
unbounded group: member sets are returned as (window, member) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefns as TF

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_by(df: DataFrame, *cols) -> DataFrame:
    """Row count per value of one or more columns."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def count_by_month(df: DataFrame, ms_col: str = "sys_ms") -> DataFrame:
    """A5: rows per UTC month of an epoch-ms column."""
    return df.groupBy(TF.ms_month(ms_col).alias("month")).agg(F.count(F.lit(1)).alias("count"))


def counts_per_second(df: DataFrame, ms_col: str = "sys_ms", upper: str | None = None,
                      sep: str = "-") -> DataFrame:
    """Rows per ``yyyy-MM-dd-HH:mm:ss`` text; with ``upper``, text ≤ it (string
    comparison, so the bound's own day is excluded), sorted. ``COUNT(date)``
    skips null times."""
    d = df.select(TF.ms_to_second_str(ms_col, sep).alias("date"))
    if upper is not None:
        d = d.filter(F.col("date") <= F.lit(upper))
    return d.groupBy("date").agg(F.count("date").alias("count")).orderBy("date")


def monthly_sum(df: DataFrame, date_col: str = "date", value_col: str = "num_bikes") -> DataFrame:
    """Sum of an integer column by (year, month) of a date, sorted."""
    d = F.to_date(_c(date_col))
    return (df.groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
            .agg(F.sum(_c(value_col).try_cast("int")).alias("sum_bikes"))
            .orderBy("year", "month"))


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Envelope and count of a point set (one row)."""
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"),
                  F.max(y).alias("maxy"), F.count(F.lit(1)).alias("count"))


def geohash_hourly_counts(df: DataFrame, precision: int = 8, lng: str = "lng", lat: str = "lat",
                          ms_col: str = "sys_ms") -> DataFrame:
    """A1: points per geohash cell per UTC hour (``yyyy-MM-dd-HH``)."""
    from ..functions.geohash import with_geohash
    d = with_geohash(df.select(lng, lat, ms_col), lng, lat, precision, "envelope")
    return (d.select("envelope", TF.ms_to_hour_str(ms_col).alias("date"))
            .groupBy("envelope", "date").agg(F.count(F.lit(1)).alias("count")))


# ---- equal grid (X2, A2, A3) -------------------------------------------------------

def equal_grid(spark, envelope, nx: int, ny: int) -> DataFrame:
    """The grid as a small parameter table (cell, minx, miny, maxx, maxy);
    cell = ix * ny + iy (x-major)."""
    minx, miny, maxx, maxy = envelope
    dx, dy = (maxx - minx) / nx, (maxy - miny) / ny
    r = spark.range(nx * ny).select(F.col("id").alias("cell"))
    ix = (F.col("cell") / F.lit(ny)).cast("long")
    iy = F.col("cell") % F.lit(ny)
    return r.select("cell",
                    (F.lit(minx) + ix * F.lit(dx)).alias("minx"), (F.lit(miny) + iy * F.lit(dy)).alias("miny"),
                    (F.lit(minx) + (ix + 1) * F.lit(dx)).alias("maxx"), (F.lit(miny) + (iy + 1) * F.lit(dy)).alias("maxy"))


def equal_grid_cell(x, y, envelope, nx: int, ny: int) -> Column:
    """Cell id of a point, null outside the envelope. Cells are half-open
    [lo, hi); the max edges belong to the last cell, so each point counts once."""
    minx, miny, maxx, maxy = envelope
    dx, dy = (maxx - minx) / nx, (maxy - miny) / ny
    ix = F.least(F.floor((_c(x) - F.lit(minx)) / F.lit(dx)), F.lit(nx - 1)).cast("long")
    iy = F.least(F.floor((_c(y) - F.lit(miny)) / F.lit(dy)), F.lit(ny - 1)).cast("long")
    inside = (_c(x) >= F.lit(minx)) & (_c(x) <= F.lit(maxx)) & (_c(y) >= F.lit(miny)) & (_c(y) <= F.lit(maxy))
    return F.when(inside, ix * F.lit(ny) + iy)


def equal_grid_counts(df: DataFrame, envelope, nx: int, ny: int,
                      lng: str = "lng", lat: str = "lat") -> DataFrame:
    """A2: points per equal-grid cell (points outside the envelope dropped)."""
    return (df.select(equal_grid_cell(lng, lat, envelope, nx, ny).alias("cell"))
            .filter(F.col("cell").isNotNull())
            .groupBy("cell").agg(F.count(F.lit(1)).alias("count")))


def equal_grid_hourly_counts(df: DataFrame, start, end, envelope, nx: int, ny: int,
                             lng: str = "lng", lat: str = "lat",
                             ms_col: str = "sys_ms", drop_boundary: bool = True) -> DataFrame:
    """A3: points per cell per UTC hour over [start, end).

    Hours without any point emit nothing; every other hour emits every cell,
    zero-filled. The reference tests each hour with open bounds, so a point
    exactly on the hour is dropped (``drop_boundary``). One pass over the
    points; the counts per (hour, cell) are filled by ``dense_cells``.
    """
    lo, hi = TF.to_ms_literal(start), TF.to_ms_literal(end)
    t = F.col(ms_col)
    cond = (t > F.lit(lo)) & (t < F.lit(hi))
    if drop_boundary:
        cond = cond & (F.pmod(t, F.lit(TF.MS_PER_HOUR)) != F.lit(0))
    pts = df.filter(cond).select(
        F.floor(t / F.lit(TF.MS_PER_HOUR)).cast("long").alias("_h"),
        equal_grid_cell(lng, lat, envelope, nx, ny).alias("cell")).filter(F.col("cell").isNotNull())
    counts = pts.groupBy("_h", "cell").agg(F.count(F.lit(1)).alias("n"))
    dense = dense_cells(counts, "_h", nx * ny, label=TF.ms_to_hour_str(F.col("_h") * F.lit(TF.MS_PER_HOUR)))
    return dense.select(F.col("label").alias("hour"), "cell", F.col("n").alias("count"))


#: Cells of a group that are filled in one task.
GAP_BLOCK = 1 << 16


def dense_cells(counts: DataFrame, group: str, n_cells: int, label: Column | None = None, block: int = GAP_BLOCK) -> DataFrame:
    """Counts per (``group``, cell) with a row for every cell 0 to n_cells - 1 of
    each group that occurs: group, label, cell, n.

    Each present cell emits itself and the gap up to the next present one, found by
    ``lead``; so the work is linear in the rows that come out. Cells are taken in
    blocks: a block's first cell is always present (with a count of zero if need
    be), so a block fills itself and a group of any number of cells is many tasks.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_cells - 1) // block).cast("long")))
    # summed, not distinct: the counts' shuffle is reused instead of a second scan
    groups = counts.groupBy(group).agg(F.sum("n").alias("_n")).filter("_n > 0")
    first = groups.select(group, starts.alias("_b")).select(group, (F.col("_b") * block).alias("cell"), F.lit(0).cast("long").alias("n"))
    both = counts.select(group, F.col("cell").cast("long").alias("cell"), F.col("n").cast("long").alias("n")).unionByName(first)
    both = both.withColumn("_b", F.floor(F.col("cell") / block).cast("long")).repartition(group, "_b")
    present = both.groupBy(group, "_b", "cell").agg(F.sum("n").alias("n"))
    last = F.least((F.col("_b") + 1) * block, F.lit(n_cells)) - 1
    upto = F.coalesce(F.lead("cell").over(Window.partitionBy(group, "_b").orderBy("cell")) - 1, last)
    spans = present.select(group, (label if label is not None else F.col(group)).alias("label"), F.col("cell").alias("_at"), "n", upto.alias("_to"))
    rows = spans.withColumn("cell", F.explode(F.sequence("_at", "_to")))
    return rows.select(group, "label", "cell", F.when(F.col("cell") == F.col("_at"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"))


# ---- join reports (modes 1-6) --------------------------------------------------------

def join_cardinality(pairs: DataFrame, window_cols: list[str]) -> DataFrame:
    """A8 (modes 1 and 6): number of windows with at least one match."""
    return pairs.select(*window_cols).distinct().agg(F.count(F.lit(1)).alias("n_windows"))


def join_members(pairs: DataFrame, window_cols: list[str], member_cols: list[str], unique: bool = False) -> DataFrame:
    """A9 (mode 2): each window with its member set, as distinct
    (window, member) rows — a set of any size never sits in one row.
    ``unique``: the pairs are of distinct windows and distinct members, so no
    shuffle is needed to make them so."""
    members = pairs.select(*window_cols, *member_cols)
    return members if unique else members.distinct()


def density_rank(counts: DataFrame, window_cols: list[str], area) -> DataFrame:
    """A10 (mode 3): all windows by density = n / area, descending; ties by window."""
    a = area if isinstance(area, Column) else F.lit(float(area))
    return (counts.withColumn("density", F.col("n") / a)
            .orderBy(F.col("density").desc(), *[F.col(c).asc() for c in window_cols]))


def top_density(counts: DataFrame, window_cols: list[str], area, n: int = 10) -> DataFrame:
    """A11 (mode 4): top-n windows by density (planned as TakeOrderedAndProject)."""
    return density_rank(counts, window_cols, area).limit(n)


def top_count(counts: DataFrame, window_cols: list[str], n: int = 10) -> DataFrame:
    """A12 (mode 5): top-n windows by member count; ties by window."""
    return counts.orderBy(F.col("n").desc(), *[F.col(c).asc() for c in window_cols]).limit(n)
