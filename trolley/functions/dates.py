"""Date columns and date windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

HOUR_FORMAT = "yyMMddHH"


def days_before(day: Column, n: int) -> Column:
    return F.date_sub(day.cast("date"), n)


def date_key(day: Column) -> Column:
    """A date as `yyyyMMdd`."""
    return F.date_format(day.cast("date"), "yyyyMMdd")


def epoch_start(day: Column) -> Column:
    """Seconds from the epoch to the start of a UTC day."""
    return F.unix_date(day.cast("date")).cast("bigint") * 86400


def inside(ts: Column, start: dt.date, stop: dt.date) -> Column:
    """Within whole days start..stop; the upper end is the start of the day after `stop`."""
    return (ts >= F.lit(start)) & (ts < F.lit(stop + dt.timedelta(days=1)))


def in_window(df: DataFrame, ts: str, start: dt.date, stop: dt.date) -> DataFrame:
    """Rows of a date window. Plain comparisons on the column, so they reach the scan."""
    return df.filter(inside(F.col(ts), start, stop))


def hour_parts(hour: Column) -> dict[str, Column]:
    """Calendar parts of a `yyMMddHH` text; Monday is weekday 0."""
    at = F.to_timestamp_ntz(hour, F.lit(HOUR_FORMAT))
    return {
        "year": F.year(at),
        "month": F.month(at),
        "day": F.day(at),
        "hour": F.hour(at),
        "weekday": F.weekday(at),
    }
