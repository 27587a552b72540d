"""Time helpers that do not depend on the session time zone.

Instants are carried as zone-less UTC wall-clock values (``timestamp_ntz``) or as
microseconds since the epoch; local times are derived with ``convert_timezone``.
Bounds are converted to UTC on the driver side (constant-folded literals) so that
the comparison on the raw column is pushed down to the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)
LEAD_TZ = "Asia/Jakarta"  # fixed value: time zone of the lead forms


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_local(col: Column | str, tz: str = LEAD_TZ) -> Column:
    """UTC wall clock -> wall clock in ``tz`` (both ``timestamp_ntz``)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(col).cast("timestamp_ntz"))


def micros_to_ntz(col: Column | str) -> Column:
    """Microseconds since the epoch -> UTC wall clock."""
    return F.timestamp_add("MICROSECOND", _c(col), ntz_lit(EPOCH))


def ntz_to_micros(col: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz_lit(EPOCH), _c(col))


def local_to_utc(value: dt.datetime, tz: str = LEAD_TZ) -> dt.datetime:
    """Driver-side conversion of a local bound to a UTC wall-clock bound."""
    aware = value.replace(tzinfo=ZoneInfo(tz))
    return aware.astimezone(dt.timezone.utc).replace(tzinfo=None)


def ntz_lit(value: dt.datetime | dt.date) -> Column:
    """A zone-less timestamp literal. Built from text: a Python ``datetime``
    literal would be converted through the Python and the session time zones."""
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day_range(col: Column | str, day: dt.date) -> Column:
    """``DATE(col) = day`` written as a half-open range on the raw column, so the
    predicate is pushed to the scan (a cast of the column would not be)."""
    start = dt.datetime(day.year, day.month, day.day)
    return (_c(col) >= ntz_lit(start)) & (_c(col) < ntz_lit(start + dt.timedelta(days=1)))


def day_text(d: dt.date) -> str:
    """Date -> ``yyyyMMdd`` partition value."""
    return d.strftime("%Y%m%d")
