"""Request frontier.

Calendars are generated per row of a ranges DataFrame with ``sequence`` + ``explode``:
each range expands inside its own task, there is no cross join, and the output grows
only with the number of days requested.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import ISO_DATE
from quire.sources.portals import CONTENT_PATH, METADATA_PATH, STRUCTURE_PATH, portals

# Fixed-date national holidays (MM-dd) used as the default holiday rule.
FIXED_HOLIDAYS = ["01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "12-25"]


def expand_days(ranges: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One row per day in [start, end] (inclusive) for every range row; start > end
    yields nothing (Spark's sequence would otherwise count down)."""
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    return (ranges.where(s <= e)
                  .withColumn("d", F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY")))))


def is_weekday(d: Column) -> Column:
    """Monday..Friday (Spark weekday(): Monday = 0)."""
    return F.weekday(d) < 5


def weekdays(ranges: DataFrame, holidays: DataFrame | None = None, start: str = "start_date",
             end: str = "end_date") -> DataFrame:
    """S2 + J10: all Mon-Fri days of each range, minus holidays (a ``d`` date column).
    Spark sizes the anti join (holidays: one row per calendar day at most)."""
    days = expand_days(ranges, start, end).where(is_weekday(F.col("d")))
    if holidays is not None:
        days = days.join(holidays.select(F.col("d").cast("date").alias("d")).distinct(), "d", "left_anti")
    return days


def get_workdays(spark: SparkSession, start: dt.date | dt.datetime, end: dt.date | dt.datetime | None = None,
                 holidays=None) -> DataFrame:
    """S2 for literal arguments: end defaults to today, datetimes are truncated to dates."""
    if isinstance(start, dt.datetime):
        start = start.date()
    end = end or dt.date.today()
    if isinstance(end, dt.datetime):
        end = end.date()
    r = spark.createDataFrame([(start, end)], "start_date date, end_date date")
    hol = None
    if holidays:
        hol = spark.createDataFrame([(h,) for h in holidays], "d date")
    return weekdays(r, hol).select("d").orderBy("d")


def metadata_urls(days: DataFrame, domain: str = "domain_url", d: str = "d") -> Column:
    """S3: {domain}{METADATA_PATH}{yyyy-MM-dd}.json"""
    return F.concat(F.col(domain), F.lit(METADATA_PATH), F.date_format(F.col(d), ISO_DATE), F.lit(".json"))


def structure_url(domain: Column, edition_id: Column) -> Column:
    """{domain}{STRUCTURE_PATH}{edition_id}"""
    return F.concat(domain, F.lit(STRUCTURE_PATH), edition_id.cast("string"))


def content_url(domain: Column, identifier: Column) -> Column:
    """{domain}{CONTENT_PATH}{identifier}"""
    return F.concat(domain, F.lit(CONTENT_PATH), identifier.cast("string"))


def metadata_frontier(spark: SparkSession, ranges: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """S1 + S3: ranges(municipality, start_date, end_date) -> one metadata request per
    weekday. The portal dimension (5 rows) is broadcast."""
    p = portals(spark).select(F.col("name").alias("municipality"), "domain_url")
    days = weekdays(ranges.join(p, "municipality"), holidays)
    return days.select("municipality", F.date_format("d", ISO_DATE).alias("request_key"),
                       metadata_urls(days).alias("url"))
