"""Projections and filters.

Bounds are folded to literals on the driver so every filter is a plain
comparison Catalyst can push to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefns as TF

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ntz_literal(ms: int) -> Column:
    """Exact TIMESTAMP_NTZ literal for an epoch-ms value (no zone involved)."""
    txt = TF.ms_to_timestamp_ntz(ms).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ'{txt}'")


def time_range(df: DataFrame, start=None, end=None, ms_col: str = "sys_ms",
               closed: str = "none", whole_days: bool = False, ts_col: str | None = None) -> DataFrame:
    """Keep rows with ``start < ms < end`` (``closed`` = none / left /
    right / both). ``whole_days`` snaps both bounds to midnight UTC as the
    reference's ``yyyy-MM-dd`` bounds do.

    ``ts_col`` names the raw TIMESTAMP_NTZ column that ``ms_col`` was derived
    from, if the frame still has it: the same range is then also stated on it.
    That predicate is exactly equivalent (ms = floor(µs / 1000)) and, unlike
    one on the derived column, reaches the Parquet scan as a pushed filter, so
    row groups outside the range are skipped.
    """
    lo = TF.day_floor_ms(start) if (whole_days and start is not None) else TF.to_ms_literal(start)
    hi = TF.day_floor_ms(end) if (whole_days and end is not None) else TF.to_ms_literal(end)
    c = F.col(ms_col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= F.lit(lo)) if closed in ("left", "both") else (c > F.lit(lo)))
    if hi is not None:
        cond = cond & ((c <= F.lit(hi)) if closed in ("right", "both") else (c < F.lit(hi)))
    if ts_col:
        ts = F.col(ts_col)
        if lo is not None:
            first = lo if closed in ("left", "both") else lo + 1
            cond = cond & (ts >= _ntz_literal(first))
        if hi is not None:
            last = hi + 1 if closed in ("right", "both") else hi
            cond = cond & (ts < _ntz_literal(last))
    return df.filter(cond)


def hour_is(df: DataFrame, hour: int = 8, ms_col: str = "sys_ms") -> DataFrame:
    """UTC hour of day equals ``hour``."""
    return df.filter(TF.ms_hour(ms_col) == F.lit(hour))


def season_filter(df: DataFrame, months, areas, ms_col: str = "sys_ms",
                  area_col: str = "area_code", drop_zero: bool = True) -> DataFrame:
    """Month in a set, zero timestamps excluded, area code in a set (``None``: any)."""
    cond = TF.ms_month(ms_col).isin(*months)
    if drop_zero:
        cond = cond & (F.col(ms_col) != F.lit(0))
    if areas is not None:
        cond = cond & F.col(area_col).isin(*areas)
    return df.filter(cond)


def within_bbox(df: DataFrame, bbox, x: str = "lng", y: str = "lat") -> DataFrame:
    """Point strictly inside (minx, miny, maxx, maxy).

    The reference projects the box and the points to EPSG:3857 and tests
    there; the projection is monotone per axis, so testing the lng/lat columns
    against the unprojected box is the same predicate, exact, and pushable.
    """
    minx, miny, maxx, maxy = bbox
    return df.filter((F.col(x) > F.lit(minx)) & (F.col(x) < F.lit(maxx))
                     & (F.col(y) > F.lit(miny)) & (F.col(y) < F.lit(maxy)))


def category_filter(df: DataFrame, col: str, values) -> DataFrame:
    """Category column in a set of labels."""
    return df.filter(F.col(col).isin(*values))


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Emit (b, a), e.g. lat/lng swapped."""
    return df.select(F.col(b), F.col(a))


def date_text_at_most(df: DataFrame, col: str, bound: str) -> DataFrame:
    """P10: lexicographic ``text <= bound`` (so a full timestamp text of the
    bound's day is excluded, as in the reference)."""
    return df.filter(F.col(col) <= F.lit(bound))
