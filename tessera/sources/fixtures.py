"""Spatial fixtures derived from the supplied tables (FIXTURES.md §2).

The supplied parquet tables hold no coordinates, so coordinates are derived by
integer hashing of keys. The recipes are the contract shared with the SQL
oracle in ``tessera.plans.catalog``: change one and the other must follow.
Every fixture is a lazy DataFrame over the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.timefns import ms_of_timestamp

# ---- fixed values (fixture contract) -----------------------------------------------
LNG0, LNG_SPAN = 116.20, 0.28
LAT0, LAT_SPAN = 39.83, 0.18
ROAD_X0, ROAD_Y0 = 12935000, 4841000
FISHNET_X0, FISHNET_Y0, FISHNET_CELL, FISHNET_NX, FISHNET_NY = 12935000.0, 4841000.0, 1000.0, 32, 27
# ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hash_coord(a, ka, b, kb, mod, base, span):
    k = (F.col(a) * F.lit(ka) + (F.col(b) * F.lit(kb) if b else F.lit(0))) % F.lit(mod)
    return F.lit(base) + k.cast("double") / F.lit(float(mod)) * F.lit(span)


def with_mercator(df: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    x, y = crs.to_mercator(lng, lat)
    return df.withColumn("x", x).withColumn("y", y)


def points(spark: SparkSession, sf_dir: str, mercator: bool = True) -> DataFrame:
    """Timestamped GPS points from ``events``.

    Columns: ts (raw timestamp, kept so time filters reach the scan),
    event_id, lng, lat, sys_ms, area_code, company_code, num_bikes (+ x, y in
    EPSG:3857).
    """
    return points_from_events(table(spark, sf_dir, "events"), mercator, keep_ts=True)


def points_from_events(ev: DataFrame, mercator: bool = True, keep_ts: bool = False) -> DataFrame:
    """The ``points`` recipe on any frame with the ``events`` columns (batch
    or streaming)."""
    extra = [F.col("ts")] if keep_ts else []
    df = ev.select(*extra,
        "event_id",
        _hash_coord("user_id", 7919, "event_id", 104729, 1000003, LNG0, LNG_SPAN).alias("lng"),
        _hash_coord("user_id", 15485863, "event_id", 1299709, 1000033, LAT0, LAT_SPAN).alias("lat"),
        ms_of_timestamp("ts").alias("sys_ms"),
        (F.lit(110101) + F.col("user_id") % F.lit(20)).cast("string").alias("area_code"),
        F.col("event_type").alias("company_code"),
        F.col("value").cast("int").alias("num_bikes"),
    )
    return with_mercator(df) if mercator else df


def points_by_month(spark: SparkSession, sf_dir: str, mercator: bool = True) -> DataFrame:
    """Points over several years from ``orders`` (all at midnight)."""
    o = table(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("event_id"),
        _hash_coord("o_custkey", 7919, "o_orderkey", 104729, 1000003, LNG0, LNG_SPAN).alias("lng"),
        _hash_coord("o_custkey", 15485863, "o_orderkey", 1299709, 1000033, LAT0, LAT_SPAN).alias("lat"),
        ms_of_timestamp("o_orderdate").alias("sys_ms"),
        (F.lit(110101) + F.col("o_custkey") % F.lit(20)).cast("string").alias("area_code"),
        F.col("o_orderstatus").alias("company_code"),
    )
    return with_mercator(df) if mercator else df


def pois(spark: SparkSession, sf_dir: str, mercator: bool = True, ident=None) -> DataFrame:
    """POIs from ``supplier``: objectid, name, lng, lat (+ x, y). ``ident``: the
    number that places a POI, its key by default."""
    s = table(spark, sf_dir, "supplier").withColumn("_place", F.col("s_suppkey") if ident is None else ident)
    df = s.select(
        F.col("s_suppkey").alias("objectid"),
        F.col("s_name").alias("name"),
        _hash_coord("_place", 7919, None, 0, 10007, LNG0, LNG_SPAN).alias("lng"),
        _hash_coord("_place", 104729, None, 0, 10009, LAT0, LAT_SPAN).alias("lat"),
    )
    return with_mercator(df) if mercator else df


def cases(spark: SparkSession, sf_dir: str, mercator: bool = True) -> DataFrame:
    """Dated cases from ``nation``: case_id, date (yyyy-MM-dd), lng, lat (+ x, y)."""
    n = table(spark, sf_dir, "nation")
    df = n.select(
        F.col("n_nationkey").cast("long").alias("case_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).cast("string").alias("date"),
        _hash_coord("n_nationkey", 6101, None, 0, 997, LNG0, LNG_SPAN).alias("lng"),
        _hash_coord("n_nationkey", 3571, None, 0, 991, LAT0, LAT_SPAN).alias("lat"),
    )
    return with_mercator(df) if mercator else df


def _int_txt(c):
    return c.cast("long").cast("string")


def roads(spark: SparkSession, sf_dir: str, ident=None) -> DataFrame:
    """Roads from every ``part`` row: id, wkt (5-vertex LINESTRING in 3857).
    ``ident``: the number that names and places a road, its key by default."""
    p = table(spark, sf_dir, "part")
    ident = F.col("p_partkey") if ident is None else ident
    verts = []
    for k in range(5):
        x = F.lit(ROAD_X0) + (ident * F.lit(7919)) % F.lit(31000) + F.lit(k * 400)
        y = F.lit(ROAD_Y0) + (ident * F.lit(104729)) % F.lit(26000) + (ident * F.lit(k * 37)) % F.lit(500)
        verts.append(F.concat(_int_txt(x), F.lit(" "), _int_txt(y)))
    wkt = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", *verts), F.lit(")"))
    return p.select(ident.alias("id"), wkt.alias("wkt"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled concave areas from every ``part`` row: id, wkt."""
    p = table(spark, sf_dir, "part")
    ident = F.col("p_partkey")
    cx = F.lit(ROAD_X0) + (ident * F.lit(6113)) % F.lit(31000)
    cy = F.lit(ROAD_Y0) + (ident * F.lit(9973)) % F.lit(26000)
    pts = [(cx - 600, cy - 600), (cx + 600, cy - 600), (cx + 600, cy + 600), (cx, cy),
           (cx - 600, cy + 600), (cx - 600, cy - 600)]
    ring = F.concat_ws(", ", *[F.concat(_int_txt(a), F.lit(" "), _int_txt(b)) for a, b in pts])
    return p.select(ident.alias("id"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def holed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square rings of different sizes from every ``part`` row: id, wkt (a shell and a hole)."""
    p = table(spark, sf_dir, "part")
    ident = F.col("p_partkey")
    cx = F.lit(ROAD_X0) + (ident * F.lit(6113)) % F.lit(31000)
    cy = F.lit(ROAD_Y0) + (ident * F.lit(9973)) % F.lit(26000)

    def ring(r, corners):
        return F.concat_ws(", ", *[F.concat(_int_txt(cx + r * F.lit(a)), F.lit(" "), _int_txt(cy + r * F.lit(b))) for a, b in corners])
    shell = ring(F.lit(300) + (ident * F.lit(37)) % F.lit(500), ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))
    hole = ring(F.lit(50) + (ident * F.lit(53)) % F.lit(200), ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1)))
    return p.select(ident.alias("id"), F.concat(F.lit("POLYGON (("), shell, F.lit("), ("), hole, F.lit("))")).alias("wkt"))


def fishnet(spark: SparkSession, x0: float = FISHNET_X0, y0: float = FISHNET_Y0,
            cell: float = FISHNET_CELL, nx: int = FISHNET_NX, ny: int = FISHNET_NY) -> DataFrame:
    """Regular fishnet polygons: oid = row * nx + col, WKT squares."""
    r = spark.range(nx * ny).select(F.col("id").alias("oid"))
    col = F.col("oid") % F.lit(nx)
    row = (F.col("oid") / F.lit(nx)).cast("long")
    minx = F.lit(x0) + col.cast("double") * F.lit(cell)
    miny = F.lit(y0) + row.cast("double") * F.lit(cell)
    maxx, maxy = minx + F.lit(cell), miny + F.lit(cell)

    def v(a, b):
        return F.concat(_int_txt(a), F.lit(" "), _int_txt(b))
    ring = F.concat_ws(", ", v(minx, miny), v(maxx, miny), v(maxx, maxy), v(minx, maxy), v(minx, miny))
    return r.select("oid", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))
