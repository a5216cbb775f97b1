"""Corpus assembly.

All keyed work is expressed as aggregations or joins on the corpus keys so Spark can
partially aggregate before shuffling. A hot key (one identifier or edition holding a
large share of rows) is reduced map-side: the keep-deepest dedupe plans a partial
rank-limit per task before its shuffle, and counts are partial hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import edition_hash
from quire.operators.ranking import numbered

EDITION_KEY = ("municipality", "edition_id")
ARTICLE_DEDUPE_KEY = ("municipality", "identifier")


def dedupe_keep_deepest(articles: DataFrame, key=ARTICLE_DEDUPE_KEY, depth: str = "depth",
                        order="ord") -> DataFrame:
    """J1 + U3: one row per key: the greatest depth wins, ties go to the first seen
    (smallest ``order``: a column name or a list of them, compared left to right).
    Rows with a NULL key component are not deduplicated here; route them to rejects
    first (D2). Plain (non-struct) order columns keep Spark's prefix sort usable."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*key).orderBy(F.desc(depth), *[F.asc(o) for o in order])
    return articles.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def duplicates_removed(articles: DataFrame, key=ARTICLE_DEDUPE_KEY) -> DataFrame:
    """Rows in, distinct keys, rows removed."""
    distinct_keys = articles.select(*key).distinct().agg(F.count(F.lit(1))).scalar()
    return articles.agg(F.count(F.lit(1)).alias("rows_in")).select(
        "rows_in", distinct_keys.alias("rows_out"), (F.col("rows_in") - distinct_keys).alias("removed"))


def latest_editions(editions: DataFrame, key=EDITION_KEY, order="ord") -> DataFrame:
    """J2 metadata dedupe: the last occurrence of an edition key wins (``order``: a
    column or a list of columns, compared left to right). Partial rank-limit per task
    before the shuffle, as for the article dedupe."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return editions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def orphan_articles(articles: DataFrame, editions: DataFrame, key=EDITION_KEY) -> DataFrame:
    """Articles whose edition is unknown."""
    return articles.join(editions.select(*key), list(key), "left_anti")


def empty_editions(editions: DataFrame, articles: DataFrame, key=EDITION_KEY) -> DataFrame:
    """Editions with no article."""
    return editions.join(articles.select(*key), list(key), "left_anti")


def with_article_counts(editions: DataFrame, articles: DataFrame, key=EDITION_KEY,
                        name: str = "total_articles") -> DataFrame:
    """J2 + A1: every edition with its article count (0 if none). The count is a
    partial aggregate; the join then sees one row per key on each side."""
    counts = articles.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return (editions.join(counts, list(key), "left")
                    .withColumn(name, F.coalesce(F.col("_n"), F.lit(0)).cast("int")).drop("_n"))


def with_edition_hash(editions: DataFrame, date_str: str = "publication_date_str",
                      n: str = "total_articles") -> DataFrame:
    """P15."""
    return editions.withColumn("edition_hash", edition_hash(F.col("edition_id"), F.col(date_str), F.col(n)))


def edition_article_lists(editions: DataFrame, articles: DataFrame, key=EDITION_KEY,
                          fields=("article_id", "identifier", "title", "depth"), order=("ord",)) -> DataFrame:
    """A31, on request only: nested ``array<struct>`` of article metadata per edition,
    sorted by first-seen order (``order`` columns, then the fields). Bodies are never
    collected. The list length is the edition's article count (bounded by one
    gazette's size, not by the corpus)."""
    order = [order] if isinstance(order, str) else list(order)
    sort_cols = [f"_o{i}" for i in range(len(order))]
    packed = articles.select(*key, F.struct(*[F.col(o).alias(n) for o, n in zip(order, sort_cols)],
                                            *fields).alias("a"))
    lists = packed.groupBy(*key).agg(F.array_sort(F.collect_list("a")).alias("_l"))
    lists = lists.select(*key, F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
                         .alias("articles"))
    return (editions.join(lists, list(key), "left")
                    .withColumn("articles", F.coalesce("articles", F.array().cast(lists.schema["articles"].dataType))))


CHUNK = 1000  # articles in one row of `edition_article_chunks`


def edition_article_chunks(articles: DataFrame, key=EDITION_KEY, fields=("article_id", "identifier", "title", "depth"),
                           order=("ord",), size: int = CHUNK) -> DataFrame:
    """A31 for editions of any length: the list of an edition in numbered chunks of ``size``
    articles (the last one shorter), by first-seen order (``order``, then the fields). No row
    holds more than a chunk and no task numbers a whole hot edition."""
    order = [order] if isinstance(order, str) else list(order)
    by = list(dict.fromkeys([*order, *fields]))
    rows = numbered(articles.select(*dict.fromkeys([*key, *by])), list(key), by)
    item = F.struct("_index", *fields).alias("a")
    lists = (rows.withColumn("chunk", F.floor(F.col("_index") / size).cast("int")).groupBy(*key, "chunk")
             .agg(F.sort_array(F.collect_list(item)).alias("l"), F.count(F.lit(1)).cast("int").alias("n_articles")))
    return lists.select(*key, "chunk", "n_articles", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("articles"))


REQUEST_KEY = ("municipality", "request_key")


def response_join(requests: DataFrame, responses: DataFrame, key=REQUEST_KEY) -> DataFrame:
    """Align responses to requests by portal and key (not by position); requests without
    a response keep NULL response columns."""
    return requests.join(responses, list(key), "left")
