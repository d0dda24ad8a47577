"""Map-tile rasters as pixel tables.

The reference renders one image per zoom in a driver loop. Here all zoom
levels come from one ``explode(sequence(minZ, maxZ))`` and the result is a
pixel table (z, tx, ty, px, py, value) that an image writer can consume per
tile; no image is encoded. Pixels live on a global grid of 256·2^z per axis,
so tiles are ``pixel div 256`` and blurs cross tile edges naturally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom as G
from ..functions.tiles import EQUATOR, TILE_SIZE, tile_of_mercator, tile_to_mercator

# ---- fixed values -------------------------------------------------------------------
MAX_PIXEL_COUNT = 2.0   # counts are capped at this value before normalising
# ----------------------------------------------------------------------------------


BLOCK = 64               # steps of a segment in one piece: it lies in four tiles at most
STRIP = 64               # rows of pixels of a tile that are one part


def _scale(z: Column) -> Column:
    return F.pow(F.lit(2.0), z) * F.lit(float(TILE_SIZE))


def global_pixel_x(x, z: Column) -> Column:
    xc = F.col(x) if isinstance(x, str) else x
    return (xc + F.lit(EQUATOR / 2.0)) / F.lit(EQUATOR) * _scale(z)


def global_pixel_y(y, z: Column) -> Column:
    yc = F.col(y) if isinstance(y, str) else y
    return (F.lit(EQUATOR / 2.0) - yc) / F.lit(EQUATOR) * _scale(z)


def _split(df: DataFrame, value_cols) -> DataFrame:
    t = F.lit(TILE_SIZE)
    return df.select("z", (F.col("gx") / t).cast("long").alias("tx"), (F.col("gy") / t).cast("long").alias("ty"),
                     F.pmod("gx", t).alias("px"), F.pmod("gy", t).alias("py"), *value_cols)


def _zooms(df: DataFrame, zmin: int, zmax: int) -> DataFrame:
    return df.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))


def tile_offsets(extent: DataFrame, max_zoom: int) -> DataFrame:
    """Top-left tile of an extent for each zoom 0..max_zoom."""
    e = _zooms(extent, 0, max_zoom)
    t = tile_of_mercator("minx", "maxy", F.col("z"))
    return e.select("z", t["x"].alias("tx"), t["y"].alias("ty"))


def tile_bounds(extent: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Extent snapped outward to tile edges per zoom (far tile + 1)."""
    e = _zooms(extent, min_zoom, max_zoom)
    t1 = tile_of_mercator("minx", "maxy", F.col("z"))
    t2 = tile_of_mercator("maxx", "miny", F.col("z"))
    nw = tile_to_mercator(t1["x"], t1["y"], F.col("z"))
    se = tile_to_mercator(t2["x"] + 1, t2["y"] + 1, F.col("z"))
    return e.select("z", nw["x"].alias("west"), nw["y"].alias("north"), se["x"].alias("east"), se["y"].alias("south"))


def heat_pixels(points: DataFrame, min_zoom: int, max_zoom: int, x: str = "x", y: str = "y",
                cap: float = MAX_PIXEL_COUNT, region=None) -> DataFrame:
    """Point count per pixel for every zoom in [min_zoom, max_zoom];
    ``value = least(n, cap) / cap``. ``region`` (minx, miny, maxx, maxy in
    3857) clips the points first. Points are counted once, at the finest zoom;
    a coarser pixel is the sum of the finer ones under it."""
    p = points.select(x, y)
    if region is not None:
        minx, miny, maxx, maxy = region
        p = p.filter((F.col(x) >= minx) & (F.col(x) <= maxx) & (F.col(y) >= miny) & (F.col(y) <= maxy))
    z = F.lit(max_zoom)
    fine = p.select(F.floor(global_pixel_x(x, z)).alias("gx"), F.floor(global_pixel_y(y, z)).alias("gy")) \
        .groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))
    steps = _zooms(fine, min_zoom, max_zoom)
    down = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(max_zoom) - F.col("z"))
    counts = steps.select("z", F.floor(F.col("gx") / down).alias("gx"), F.floor(F.col("gy") / down).alias("gy"), "n") \
        .groupBy("z", "gx", "gy").agg(F.sum("n").alias("n"))
    out = _split(counts, ["n"])
    return out.withColumn("value", F.least(F.col("n").cast("double"), F.lit(cap)) / F.lit(cap))


def blur_pixels(pixels: DataFrame, radius: int = 1, cap: float = MAX_PIXEL_COUNT) -> DataFrame:
    """Box blur of the heat map: each pixel spreads n / (2r+1)^2 to its
    neighbourhood within the world (own rule), then the value is capped and
    normalised."""
    t = F.lit(TILE_SIZE)
    g = pixels.select("z", (F.col("tx") * t + F.col("px")).alias("gx"), (F.col("ty") * t + F.col("py")).alias("gy"), "n")
    offs = F.sequence(F.lit(-radius), F.lit(radius))
    g = g.withColumn("dx", F.explode(offs)).withColumn("dy", F.explode(offs))
    k = float((2 * radius + 1) ** 2)
    b = (g.select("z", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "n")
         .filter((F.col("gx") >= 0) & (F.col("gy") >= 0) & (F.col("gx") < _scale(F.col("z"))) & (F.col("gy") < _scale(F.col("z"))))
         .groupBy("z", "gx", "gy").agg((F.sum("n") / F.lit(k)).alias("v")))
    out = _split(b, ["v"])
    return out.select("z", "tx", "ty", "px", "py", (F.least("v", F.lit(cap)) / F.lit(cap)).alias("value"))


def line_pixels(lines: DataFrame, min_zoom: int, max_zoom: int, geom_col: str = "geom") -> DataFrame:
    """Pixels touched by line segments (scatter raster, one colour),
    sampled at unit steps along each segment, de-duplicated.

    Pieces of BLOCK steps are shuffled, not pixels: a piece goes to each tile of its ends' box and
    is sampled there, so that a tile's pixels are made distinct where they arise. Tiles are dealt by
    parts of their rows of pixels, so that one crowded tile is many tasks."""
    s = lines.select(F.explode(G.segments(F.col(geom_col))).alias("s"))
    s = _zooms(s, min_zoom, max_zoom)
    z = F.col("z")
    s = s.select("z", global_pixel_x(F.col("s.x1"), z).alias("gx1"), global_pixel_y(F.col("s.y1"), z).alias("gy1"),
                 global_pixel_x(F.col("s.x2"), z).alias("gx2"), global_pixel_y(F.col("s.y2"), z).alias("gy2"))
    s = s.withColumn("n", F.ceil(F.greatest(F.abs(F.col("gx2") - F.col("gx1")), F.abs(F.col("gy2") - F.col("gy1")))).cast("long"))
    s = s.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.lit(BLOCK)))))
    s = s.withColumns({"k0": F.col("b") * F.lit(BLOCK), "k1": F.least("n", F.col("b") * F.lit(BLOCK) + F.lit(BLOCK - 1))})
    at = lambda c, k: F.when(F.col("n") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(k) / F.col("n"))
    part = lambda c, size: F.floor(F.col(c) / F.lit(size))
    ends = {c + k: F.floor(at(c, k)) for c in ("gx", "gy") for k in ("k0", "k1")}
    s = s.withColumns(ends)
    for c, name, size in (("gx", "tx", TILE_SIZE), ("gy", "strip", STRIP)):
        lo, hi = F.least(f"{c}k0", f"{c}k1"), F.greatest(f"{c}k0", f"{c}k1")
        s = s.withColumn(name, F.explode(F.sequence(F.floor(lo / F.lit(size)), F.floor(hi / F.lit(size)))))
    s = s.select("z", "tx", "strip", "gx1", "gy1", "gx2", "gy2", "n", "k0", "k1")
    s = s.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "z", "tx", "strip")
    s = s.withColumn("k", F.explode(F.sequence("k0", "k1")))
    px = s.select("z", "tx", "strip", F.floor(at("gx", "k")).alias("gx"), F.floor(at("gy", "k")).alias("gy"))
    px = px.filter((part("gx", TILE_SIZE) == F.col("tx")) & (part("gy", STRIP) == F.col("strip"))).distinct()
    return _split(px, [])


def tile_summary(pixels: DataFrame, with_pixels: bool = False) -> DataFrame:
    """What each tile image would hold: pixel count, point count, max
    value; ``with_pixels`` adds the pixel list (≤ 256×256 entries per tile,
    a proven bound)."""
    aggs = [F.count(F.lit(1)).alias("n_pixels"), F.sum("n").alias("n_points"), F.max("value").alias("max_value")]
    if with_pixels:
        aggs.append(F.collect_list(F.struct("px", "py", "value")).alias("pixels"))
    return pixels.groupBy("z", "tx", "ty").agg(*aggs)
