"""Point and geometry readers.

CSV columns are read as text with an explicit schema (no inference pass over
the data unless asked), coordinates are normalised through a decimal cast,
dirty values become null, and the result is a DataFrame with the package's
point columns: ``lng, lat, sys_ms`` (+ ``x, y`` in EPSG:3857).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.geom import geom_from_wkt
from ..functions.timefns import ms_of_text


def read_csv(spark: SparkSession, path, header: bool = True, sep: str = ",",
             infer: bool = False) -> DataFrame:
    """CSV as text columns (``_c0.._cN`` without a header)."""
    r = spark.read.option("header", header).option("sep", sep)
    if infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


#: Column with the whole text of a record that its declared schema does not fit.
BAD = "_bad"


def _whole_lines(spark: SparkSession, path, header: bool) -> DataFrame:
    """``line``: the records as they stand. Spark's own CSV reader drops the header line of
    every file (it knows where each file starts), reading each whole line as one field."""
    return spark.read.option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000").option("header", header).csv(path).toDF("line")


def read_checked(spark: SparkSession, path, schema: str, header: bool = True, sep: str = ",", bad: str = BAD) -> DataFrame:
    """S1/S2 with a declared schema: typed columns, and ``bad`` with the record's text
    where a value is not of its type or there are too few or too many fields.

    Bad records stay in the result, with the fields that could be read; nothing is
    dropped and nothing stops the job. A record is one line. It is parsed whole
    (``from_csv``) whatever columns a query asks for: the file reader would parse
    those alone, and call a record bad or not accordingly.
    """
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parsed = F.from_csv("line", f"{schema}, `{bad}` string", options)
    return _whole_lines(spark, path, header).select(parsed.alias("r")).select("r.*")


def accounted(df: DataFrame, required=(), bad: str = BAD) -> DataFrame:
    """One row about records read by ``read_checked``: n_rows, n_good, n_bad, and for each
    ``required`` column n_no_<column>, the good records without a value there."""
    b = F.col(f"`{bad}`")
    missing = [F.count(F.when(b.isNull() & F.col(f"`{c}`").isNull(), 1)).alias(f"n_no_{c}") for c in required]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(b.isNull(), 1)).alias("n_good"), F.count(b).alias("n_bad"), *missing)


def to_points(df: DataFrame, lng: str = "lng", lat: str = "lat", time: str | None = "sysTime",
              keep: list[str] | None = None, scale: int = 14, mercator: bool = True,
              gcj_to_wgs: bool = False) -> DataFrame:
    """S2 + C1/C2/C4: standard point columns from raw columns.

    ``keep`` lists extra columns to carry. ``gcj_to_wgs`` applies the datum
    shift before projecting (the reference's tile job does this).
    """
    p_lng, p_lat = crs.point_cols(lng, lat, scale)
    cols = [F.col(c) for c in (keep or [])] + [p_lng.alias("lng"), p_lat.alias("lat")]
    if time is not None:
        cols.append(ms_of_text(time).alias("sys_ms"))
    out = df.select(*cols)
    if gcj_to_wgs:
        w = crs.gcj_to_wgs_arrow("lng", "lat")
        out = out.withColumn("_w", w).withColumn("lng", F.col("_w.lng")).withColumn("lat", F.col("_w.lat")).drop("_w")
    if mercator:
        x, y = crs.to_mercator("lng", "lat")
        out = out.withColumn("x", x).withColumn("y", y)
    return out


def read_points(spark: SparkSession, path, *, header: bool = True, sep: str = ",",
                lng: str | int = "lng", lat: str | int = "lat", time: str | int | None = "sysTime",
                keep: list[str] | None = None, infer: bool = False, scale: int = 14,
                mercator: bool = True, gcj_to_wgs: bool = False) -> DataFrame:
    """A CSV of points. Integer ``lng``/``lat``/``time`` select
    columns by position (headerless files, ``_cN``)."""
    df = read_csv(spark, path, header=header, sep=sep, infer=infer)

    def name(c):
        return f"_c{c}" if isinstance(c, int) else c
    return to_points(df, name(lng), name(lat), name(time) if time is not None else None,
                     keep=keep, scale=scale, mercator=mercator, gcj_to_wgs=gcj_to_wgs)


def read_lines(spark: SparkSession, path, sep: str = ",", skip_header: bool = True) -> DataFrame:
    """Raw text lines split on ``sep`` (a regex) into ``fields``.

    The header line of every file is dropped by Spark's own CSV reader (it
    knows where each file starts), reading each whole line as one field,
    instead of dropping "the first line of partition 0", which depends on how
    files are split.
    """
    df = _whole_lines(spark, path, skip_header)
    return df.select(F.split(F.trim(F.col("line")), sep).alias("fields"))


def read_wkt_table(spark: SparkSession, path, wkt_col: str = "geom", sep: str = "|",
                   header: bool = True, geom_col: str = "geometry") -> DataFrame:
    """Delimited text with a WKT column, parsed to a geometry column."""
    df = read_csv(spark, path, header=header, sep=sep)
    return df.withColumn(geom_col, geom_from_wkt(F.col(wkt_col)))
