"""Geohash encode/decode as native Spark expressions.

Encoding quantises longitude and latitude to integers and interleaves their
bits; this is the closed form of the usual bisection encoder. A value exactly
on a cell edge goes to the lower cell, as bisection with ``value > mid`` does.
No Python UDF: each character is a handful of shifts inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
# The geohash base-32 alphabet (digits, then letters without a, i, l, o).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bits(precision: int):
    total = 5 * precision
    return (total + 1) // 2, total // 2  # longitude bits, latitude bits


def _quantise(value: Column, lo: float, span: float, nbits: int) -> Column:
    cells = float(1 << nbits)
    t = (value - F.lit(lo)) / F.lit(span) * F.lit(cells)
    q = F.ceil(t) - F.lit(1)
    return F.least(F.greatest(q, F.lit(0)), F.lit((1 << nbits) - 1)).cast("long")


def _encode_quantised(q_lng: Column, q_lat: Column, precision: int) -> Column:
    n_lng, n_lat = _bits(precision)
    total = 5 * precision
    whole = None
    for j in range(total):
        src, k, n = (q_lng, j // 2, n_lng) if j % 2 == 0 else (q_lat, j // 2, n_lat)
        term = F.shiftleft(F.shiftright(src, n - 1 - k).bitwiseAND(F.lit(1)), total - 1 - j)
        whole = term if whole is None else whole.bitwiseOR(term)
    digits = F.lpad(F.lower(F.conv(whole.cast("string"), 10, 32)), precision, "0")
    return F.translate(digits, "0123456789abcdefghijklmnopqrstuv", BASE32)


def geohash_encode(lng, lat, precision: int = 8) -> Column:
    """Geohash text of (lng, lat) with ``precision`` characters.

    The interleaved 5·precision-bit integer is built with shifts, written in
    base 32 by ``conv`` and mapped onto the geohash alphabet. The quantised
    coordinates are read once per bit, so pass column references (or use
    ``with_geohash``, which projects them first and keeps codegen small).
    """
    if not 1 <= precision <= 12:
        raise ValueError("precision must be in 1..12")
    n_lng, n_lat = _bits(precision)
    out = _encode_quantised(_quantise(_c(lng), -180.0, 360.0, n_lng), _quantise(_c(lat), -90.0, 180.0, n_lat),
                            precision)
    return F.when(_c(lng).isNull() | _c(lat).isNull(), F.lit(None).cast("string")).otherwise(out)


def _deinterleave(whole: Column, parity: int) -> Column:
    out = None
    for j in range(parity, 60, 2):
        term = F.shiftleft(F.shiftright(whole, 59 - j).bitwiseAND(F.lit(1)), 29 - j // 2)
        out = term if out is None else out + term
    return out


def with_geohash_bounds(df, code: str = "geohash", prefix: str = ""):
    """G9 as a DataFrame step: adds ``lng, lat, lng_err, lat_err, min_lng,
    min_lat, max_lng, max_lat`` (with ``prefix``) for a geohash column.

    Closed form for codes of up to 12 characters: the code (right-padded to
    12) is mapped onto the standard base-32 digits and read as one 60-bit
    integer with ``conv``; its even bits form longitude, odd bits latitude,
    scaled down to the code's own bit counts. Each intermediate is its own
    projection (all codegen), so no expression is copied into its consumers.
    """
    c = F.lower(F.col(code))
    df = df.withColumn("_gh_len", F.least(F.length(c), F.lit(12)))
    df = df.withColumn("_gh_all", F.conv(F.translate(F.rpad(c, 12, "0"), BASE32,
                                                     "0123456789abcdefghijklmnopqrstuv"), 32, 10).cast("long"))
    df = df.withColumn("_gh_qx", _deinterleave(F.col("_gh_all"), 0)) \
        .withColumn("_gh_qy", _deinterleave(F.col("_gh_all"), 1))
    total = F.col("_gh_len") * F.lit(5)
    df = df.withColumn("_gh_nx", F.floor((total + F.lit(1)) / F.lit(2))).withColumn("_gh_ny", F.floor(total / F.lit(2)))
    df = df.withColumn(prefix + "lng_err", F.lit(180.0) / F.pow(F.lit(2.0), F.col("_gh_nx"))) \
        .withColumn(prefix + "lat_err", F.lit(90.0) / F.pow(F.lit(2.0), F.col("_gh_ny")))
    qx = F.floor(F.col("_gh_qx") / F.pow(F.lit(2.0), F.lit(30) - F.col("_gh_nx")))
    qy = F.floor(F.col("_gh_qy") / F.pow(F.lit(2.0), F.lit(30) - F.col("_gh_ny")))
    ok = F.col("_gh_len") > F.lit(0)
    df = df.withColumn(prefix + "lng", F.when(ok, F.lit(-180.0) + (F.lit(2.0) * qx + F.lit(1.0)) * F.col(prefix + "lng_err"))) \
        .withColumn(prefix + "lat", F.when(ok, F.lit(-90.0) + (F.lit(2.0) * qy + F.lit(1.0)) * F.col(prefix + "lat_err")))
    lng, lat, el, et = (F.col(prefix + n) for n in ("lng", "lat", "lng_err", "lat_err"))
    df = df.withColumn(prefix + "min_lng", lng - el).withColumn(prefix + "min_lat", lat - et) \
        .withColumn(prefix + "max_lng", lng + el).withColumn(prefix + "max_lat", lat + et)
    return df.drop("_gh_len", "_gh_all", "_gh_qx", "_gh_qy", "_gh_nx", "_gh_ny")


def with_point_rectangle(df, lng: str = "lng", lat: str = "lat", precision: int = 8, prefix: str = ""):
    """Rectangle of the geohash cell of each point, as the reference
    writes it (max_lng, max_lat, min_lng, min_lat)."""
    df = with_geohash(df, lng, lat, precision, "_gh_code")
    df = with_geohash_bounds(df, "_gh_code", "_ghb_")
    for n in ("max_lng", "max_lat", "min_lng", "min_lat"):
        df = df.withColumn(prefix + n, F.col("_ghb_" + n))
    return df.drop("_gh_code", *["_ghb_" + n for n in ("lng", "lat", "lng_err", "lat_err", "min_lng",
                                                       "min_lat", "max_lng", "max_lat")])




def with_geohash(df, lng: str = "lng", lat: str = "lat", precision: int = 8, name: str = "geohash"):
    """Add the geohash column in three projections: quantised longitude and
    latitude first, then the interleave, so neither the inputs nor the
    quantisation are re-expanded into every bit term (keeps the generated
    code small enough to be JIT-compiled)."""
    if not 1 <= precision <= 12:
        raise ValueError("precision must be in 1..12")
    n_lng, n_lat = _bits(precision)
    df = df.withColumn("_gh_qx", F.when(F.col(lng).isNotNull() & F.col(lat).isNotNull(),
                                        _quantise(F.col(lng), -180.0, 360.0, n_lng))) \
        .withColumn("_gh_qy", _quantise(F.col(lat), -90.0, 180.0, n_lat))
    enc = _encode_quantised(F.col("_gh_qx"), F.col("_gh_qy"), precision)
    return df.withColumn(name, F.when(F.col("_gh_qx").isNotNull(), enc)).drop("_gh_qx", "_gh_qy")
