"""Epoch-millisecond time helpers.

The reference stores time as epoch milliseconds (``sysTime``) and formats it
with the session zone. We fix the meaning to UTC and compute every field with
integer arithmetic on the millisecond value, so results do not depend on the
session time zone and every expression stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_SECOND = 1000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

_EPOCH = _dt.datetime(1970, 1, 1)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ms_of_timestamp(ts) -> Column:
    """Epoch ms of a timestamp / timestamp_ntz column, read as UTC wall time."""
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})".format(
        _sql_ref(ts)))


def _sql_ref(col) -> str:
    if isinstance(col, str):
        return "`" + col.replace("`", "``") + "`"
    raise TypeError("pass a column name")


def ms_of_text(col, try_parse: bool = True) -> Column:
    """Epoch ms held as text (CSV ``sysTime``); bad text becomes null."""
    c = _c(col)
    return c.try_cast("bigint") if try_parse else c.cast("bigint")


def ms_to_date(ms) -> Column:
    """UTC calendar date (DATE type) of an epoch-ms column."""
    return F.date_from_unix_date(F.floor(_c(ms) / F.lit(MS_PER_DAY)).cast("int"))


def ms_to_date_str(ms) -> Column:
    """``yyyy-MM-dd`` text of the UTC date."""
    return ms_to_date(ms).cast("string")


def ms_hour(ms) -> Column:
    """UTC hour of day 0..23."""
    return F.floor(F.pmod(_c(ms), F.lit(MS_PER_DAY)) / F.lit(MS_PER_HOUR)).cast("int")


def ms_minute(ms) -> Column:
    return F.floor(F.pmod(_c(ms), F.lit(MS_PER_HOUR)) / F.lit(60_000)).cast("int")


def ms_second(ms) -> Column:
    return F.floor(F.pmod(_c(ms), F.lit(60_000)) / F.lit(MS_PER_SECOND)).cast("int")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def ms_to_time_str(ms) -> Column:
    """``HH:mm:ss``."""
    return F.concat_ws(":", _two(ms_hour(ms)), _two(ms_minute(ms)), _two(ms_second(ms)))


def ms_to_hour_str(ms) -> Column:
    """``yyyy-MM-dd-HH`` (D3; the reference used the local zone, ours is UTC)."""
    return F.concat(ms_to_date_str(ms), F.lit("-"), _two(ms_hour(ms)))


def ms_to_second_str(ms, sep: str = "-") -> Column:
    """Full timestamp text ``yyyy-MM-dd<sep>HH:mm:ss``."""
    return F.concat(ms_to_date_str(ms), F.lit(sep), ms_to_time_str(ms))


def ms_month(ms) -> Column:
    """UTC month 1..12."""
    return F.month(ms_to_date(ms))


def ms_year(ms) -> Column:
    """UTC year (D5)."""
    return F.year(ms_to_date(ms))


def date_text_to_ms(col) -> Column:
    """Epoch ms of midnight UTC of a ``yyyy-MM-dd`` text column (D6 on columns)."""
    d = F.to_date(_c(col), "yyyy-MM-dd")
    return F.unix_date(d).cast("bigint") * F.lit(MS_PER_DAY)


def to_ms_literal(value) -> int:
    """Driver-side literal for a bound: date, datetime, ISO text or ms.

    Bounds are folded to an integer on the driver so the filter stays a plain
    comparison that Catalyst can push to the scan.
    """
    if value is None:
        return None
    if isinstance(value, bool):
        raise TypeError("bad time bound")
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        txt = value.strip().replace(" ", "T")
        value = _dt.datetime.fromisoformat(txt)
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        delta = value - _EPOCH
    elif isinstance(value, _dt.date):
        delta = _dt.datetime(value.year, value.month, value.day) - _EPOCH
    else:
        raise TypeError(f"unsupported time bound {value!r}")
    return (delta.days * MS_PER_DAY + delta.seconds * MS_PER_SECOND
            + delta.microseconds // 1000)


def day_floor_ms(value) -> int:
    """Midnight (UTC) of the day containing ``value``, as epoch ms."""
    ms = to_ms_literal(value)
    return (ms // MS_PER_DAY) * MS_PER_DAY


def ms_to_timestamp_ntz(ms_literal: int) -> _dt.datetime:
    """Driver-side: epoch ms → naive UTC datetime (for scan pushdown)."""
    return _EPOCH + _dt.timedelta(milliseconds=ms_literal)
