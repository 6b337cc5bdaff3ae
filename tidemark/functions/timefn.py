"""Clock, date and month-key expressions (F-01 .. F-07).

The clock is never read inside a query: callers pass ``as_of`` and it becomes
a literal, so a plan is reproducible and can be checked against another
engine.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a ``datetime``/ISO string (UTC wall time)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("date")


def now_utc() -> _dt.datetime:
    """Default clock for callers that do not pass ``as_of``."""
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def hours_before(as_of, hours: float) -> Column:
    """``as_of - hours`` as a timestamp literal (D-3: hours, not whole days)."""
    if not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.fromisoformat(str(as_of))
    return ts_lit(as_of - _dt.timedelta(hours=hours))


def days_before(as_of, days: int) -> Column:
    if not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.fromisoformat(str(as_of))
    return ts_lit(as_of - _dt.timedelta(days=days))


def epoch_seconds(c) -> Column:
    """Whole seconds since the epoch (``unix_timestamp`` semantics)."""
    return F.unix_timestamp(F.col(c) if isinstance(c, str) else c)


def hours_between(start, end) -> Column:
    """(end - start) in hours as DOUBLE, from whole seconds (F-04)."""
    return (epoch_seconds(end) - epoch_seconds(start)).cast("double") / F.lit(3600.0)


def yearmonth_of(c) -> Column:
    """``YYYYMM`` month key of a timestamp/date column (F-06)."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyyMM")


def yearmonth_from_parts(year, month) -> Column:
    """``YYYYMM`` from year and month columns/values (F-06)."""
    y = F.col(year) if isinstance(year, str) else F.lit(year)
    m = F.col(month) if isinstance(month, str) else F.lit(month)
    return F.concat(y.cast("string"), F.lpad(m.cast("string"), 2, "0"))


def yearmonth_py(year: int, month: int) -> str:
    return f"{year:04d}{month:02d}"


def day_path(prefix: str, c) -> Column:
    """``<prefix>/year=YYYY/month=MM/day=DD`` for a date column (F-07)."""
    d = F.col(c) if isinstance(c, str) else c
    return F.format_string(prefix.rstrip("/") + "/year=%04d/month=%02d/day=%02d",
                           F.year(d), F.month(d), F.dayofmonth(d))


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """String to DATE by pattern; unparseable text gives NULL (F-01)."""
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, fmt)


def parse_timestamp(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """String to TIMESTAMP by pattern; unparseable text gives NULL (F-01)."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(fmt))
