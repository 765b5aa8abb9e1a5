"""Date and time Columns. Every time window takes an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | dt.date | dt.datetime


def to_datetime(as_of: AsOf) -> dt.datetime:
    if isinstance(as_of, dt.datetime):
        return as_of
    if isinstance(as_of, dt.date):
        return dt.datetime(as_of.year, as_of.month, as_of.day)
    return dt.datetime.fromisoformat(as_of)


def moment(value: AsOf) -> Column:
    """A zone-less timestamp literal; constant, so comparisons push to the scan."""
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day_start(as_of: AsOf, days_back: int = 0) -> Column:
    day = to_datetime(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    return moment(day - dt.timedelta(days=days_back))


def since(ts: Column | str, as_of: AsOf, days: int) -> Column:
    """``ts`` lies no earlier than the start of the day ``days`` before ``as_of``."""
    return _col(ts) >= day_start(as_of, days)


def on_day(ts: Column | str, as_of: AsOf) -> Column:
    """``ts`` falls on the day of ``as_of``, as a range so that scans can prune."""
    ts = _col(ts)
    return (ts >= day_start(as_of)) & (ts < day_start(as_of, -1))


def minutes_crossed(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries between two times, not elapsed minutes: 00:59 to 01:00 is one."""
    return _minute_number(end) - _minute_number(start)


def days_crossed(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end), _col(start))


def _minute_number(ts: Column | str) -> Column:
    return F.floor(F.unix_seconds(_col(ts).cast("timestamp")) / 60)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
