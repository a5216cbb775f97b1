"""Date helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = "yyyy-MM-dd"
# Lenient pattern: accepts 2024-1-3 as strptime('%Y-%m-%d') does.
LENIENT_DATE = "yyyy-M-d"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lenient_date(s, fmt: str = LENIENT_DATE) -> Column:
    """Parse or NULL (never raises)."""
    return F.try_to_date(_c(s), fmt)


def format_date(d, fmt: str = ISO_DATE) -> Column:
    return F.date_format(_c(d), fmt)


def iso_weekday(d) -> Column:
    """Monday=1 .. Sunday=7."""
    return F.weekday(_c(d)) + 1


def year_month(y, m) -> Column:
    """'yyyy-MM' label from integer year and month."""
    return F.concat(_c(y).cast("string"), F.lit("-"), F.lpad(_c(m).cast("string"), 2, "0"))


def quarter(d) -> Column:
    """Quarter of the year, 1 to 4."""
    return F.quarter(_c(d))


def date_parts(d) -> list[Column]:
    d = _c(d)
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")]


def rolling_window(days: int = 7, end: dt.date | None = None, start: dt.date | None = None,
                   today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """end = given or today; start = given, else end - (days - 1); days=0 -> end."""
    end = end or today or dt.date.today()
    if start is None:
        start = end - dt.timedelta(days=max(days - 1, 0))
    return start, end
