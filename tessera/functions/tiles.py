"""Slippy-map tile arithmetic.

Integer conversions truncate toward zero, like a JVM ``toInt``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
# Earth circumference at the equator used by the tile scheme (metres, 3857).
EQUATOR = 40075016.68557849
TILE_SIZE = 256
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _zscale(z) -> Column:
    """2^z as a double (exact for integer zooms)."""
    return F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else _c(z))


def tile_of_lonlat(lng, lat, z) -> Column:
    """Tile holding a WGS-84 point at zoom z → ``struct<z, x, y>``."""
    n = _zscale(z)
    rad = F.radians(_c(lat))
    x = ((_c(lng) + F.lit(180.0)) / F.lit(360.0) * n).cast("int")
    y = ((F.lit(1.0) - F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)) / F.lit(2.0) * n).cast("int")
    return F.struct((F.lit(z) if isinstance(z, int) else _c(z)).alias("z"), x.alias("x"), y.alias("y"))


def tile_of_mercator(x, y, z) -> Column:
    """Tile holding an EPSG:3857 point at zoom z → ``struct<z, x, y>``."""
    n = _zscale(z)
    tx = ((_c(x) + F.lit(EQUATOR / 2.0)) / F.lit(EQUATOR) * n).cast("int")
    ty = ((F.lit(EQUATOR / 2.0) - _c(y)) / F.lit(EQUATOR) * n).cast("int")
    return F.struct((F.lit(z) if isinstance(z, int) else _c(z)).alias("z"), tx.alias("x"), ty.alias("y"))


def tile_to_lonlat(tx, ty, z) -> Column:
    """North-west corner of a tile → ``struct<lng, lat>``."""
    n = _zscale(z)
    lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * _c(ty).cast("double") / n))))
    lng = _c(tx).cast("double") / n * F.lit(360.0) - F.lit(180.0)
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def tile_to_mercator(tx, ty, z) -> Column:
    """T4: north-west corner of a tile in EPSG:3857 → ``struct<x, y>``."""
    n = _zscale(z)
    x = _c(tx).cast("double") * F.lit(EQUATOR) / n - F.lit(EQUATOR / 2.0)
    y = F.lit(EQUATOR / 2.0) - _c(ty).cast("double") * F.lit(EQUATOR) / n
    return F.struct(x.alias("x"), y.alias("y"))


def tile_path(tx, ty, z, prefix: str = "", suffix: str = ".png") -> Column:
    """T5: ``<prefix>z/x/y<suffix>`` (a path or URL text; nothing is fetched)."""
    body = F.concat_ws("/", (F.lit(z) if isinstance(z, int) else _c(z)).cast("string"),
                       _c(tx).cast("string"), _c(ty).cast("string"))
    return F.concat(F.lit(prefix), body, F.lit(suffix))


# ---- driver-side scalar versions (for literal bounds) ---------------------------

def tile_of_mercator_literal(x: float, y: float, z: int):
    n = float(1 << z)
    return int((x + EQUATOR / 2.0) / EQUATOR * n), int((EQUATOR / 2.0 - y) / EQUATOR * n)


def tile_to_mercator_literal(tx: int, ty: int, z: int):
    n = float(1 << z)
    return tx * EQUATOR / n - EQUATOR / 2.0, EQUATOR / 2.0 - ty * EQUATOR / n


def tile_bounds_literal(minx: float, miny: float, maxx: float, maxy: float, z: int):
    """T6 on the driver: envelope snapped outward to tile edges.

    Returns ((x_west, y_north), (x_east, y_south)) where the far corner is the
    north-west corner of the tile after the last one.
    """
    t1 = tile_of_mercator_literal(minx, maxy, z)
    t2 = tile_of_mercator_literal(maxx, miny, z)
    return tile_to_mercator_literal(t1[0], t1[1], z), tile_to_mercator_literal(t2[0] + 1, t2[1] + 1, z)
