"""Date keys, month labels and the reporting window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reporting window used when a request names no bounds.
DEFAULT_FROM = "2022-01-01"
DEFAULT_TO = "2023-12-31"


def date_id(day: Column) -> Column:
    """Smart key yyyymmdd; it grows with the date, so a date range is a key range."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def month_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def as_date(value: str | dt.date | None) -> dt.date | None:
    if value is None or isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value)


def request_window(
    date_from: str | None = None,
    date_to: str | None = None,
    default: tuple[str, str] = (DEFAULT_FROM, DEFAULT_TO),
):
    """Bounds of a dashboard request; a missing or empty bound takes its default."""
    return as_date(date_from or default[0]), as_date(date_to or default[1])


def date_key(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def month_labels(start: str | dt.date, end: str | dt.date) -> list[str]:
    """Labels of all months from ``start`` to ``end``, both included."""
    first, last = as_date(start), as_date(end)
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{m // 12}-{m % 12 + 1:02d}" for m in months]
