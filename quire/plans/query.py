"""F1 / T5: the article query builder.

Optional filters compose into one Column predicate (no SQL text is built from user
input). When the table is partitioned by year/month (the lake layout), the date range
is also stated on those partition columns so the scan prunes whole directories; the
exact date predicate still decides the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def partition_predicate(start: dt.date | None, end: dt.date | None) -> Column | None:
    """year*100+month within the [start, end] month range (prunes partitions)."""
    ym = F.col("year") * 100 + F.col("month")
    pred = None
    if start is not None:
        pred = ym >= start.year * 100 + start.month
    if end is not None:
        p = ym <= end.year * 100 + end.month
        pred = p if pred is None else pred & p
    return pred


def article_predicate(municipality: str | None = None, start_date=None, end_date=None,
                      content_types=None, date_col: str = "publication_date") -> Column:
    preds = []
    if municipality:
        preds.append(F.col("municipality") == municipality)
    if start_date:
        preds.append(F.col(date_col) >= F.lit(_as_date(start_date)))
    if end_date:
        preds.append(F.col(date_col) <= F.lit(_as_date(end_date)))
    if content_types:
        preds.append(F.col("content_type").isin(list(content_types)))
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


def query_articles(articles: DataFrame, municipality: str | None = None, start_date=None, end_date=None,
                   content_types=None, limit: int | None = None, order_by=None) -> DataFrame:
    """AND of the given filters; none given -> all rows. ``limit`` of 0/None -> no limit.
    ``order_by`` makes a limited result deterministic."""
    df = articles.where(article_predicate(municipality, start_date, end_date, content_types))
    if {"year", "month"} <= set(articles.columns) and (start_date or end_date):
        pp = partition_predicate(_as_date(start_date) if start_date else None,
                                 _as_date(end_date) if end_date else None)
        df = df.where(pp)
    if order_by:
        df = df.orderBy(*order_by)
    if limit:
        df = df.limit(int(limit))
    return df


def iter_editions(spark, lake_root: str, start_date=None, end_date=None, municipality: str | None = None):
    """Iterate stored editions of a date range on the driver, each with the list of
    its articles' metadata (no bodies). Rows stream one partition at a time
    (``toLocalIterator``); the per-edition list is bounded by one gazette's size."""
    from quire.operators.assemble import edition_article_lists
    from quire.sinks.lake import read_current
    eds = query_articles(read_current(spark, lake_root, "editions"), municipality, start_date, end_date)
    arts = query_articles(read_current(spark, lake_root, "articles"), municipality, start_date, end_date)
    out = edition_article_lists(eds, arts, fields=("article_id", "identifier", "title", "hierarchy_path",
                                                   "content_type", "content_size"),
                                order=("article_id",))
    return out.orderBy("publication_date", "municipality", "edition_id").toLocalIterator()
