"""Edition and article reports.

Every function takes (spark, sf_dir) and returns a lazy DataFrame. Reports read only
the columns they need (the parquet scans show a pruned ReadSchema), aggregate before
any ordering, and attach global totals through scalar subqueries rather than joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import iso_weekday, quarter, year_month
from quire.functions.text import ellipsize, gib, kib, mib, path_label, round_half_up
from quire.sources import driver

# Weekday labels (Monday first) used by the weekday report.
WEEKDAY_LABELS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]
HISTOGRAM_BINS_KB = 50
HISTOGRAM_BINS_BYTES = 40


# --------------------------------------------------------------------------- J2 / A1

def article_counts(spark: SparkSession, d: str) -> DataFrame:
    """(edition_id, n) for editions that have articles; partial aggregation map-side."""
    return (driver.articles(spark, d, with_path=False)
            .groupBy("edition_id").agg(F.count(F.lit(1)).alias("n")))


def editions_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every edition with its article count (0 when it has none): editions left-join
    the per-edition counts. Counts are aggregated before the join, so the join sees one
    row per edition on both sides."""
    e = driver.editions(spark, d)
    c = article_counts(spark, d)
    return (e.join(c, "edition_id", "left")
             .withColumn("num_articles", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))
             .drop("n"))


def per_edition_with(spark: SparkSession, d: str, edition_cols=("publication_date",)) -> DataFrame:
    """J6, pre-aggregated: (edition columns, n articles, bytes) per edition that has
    articles. Articles are counted per edition first (partial aggregation map-side), so
    the join with editions sees one row per edition, and an edition holding a large
    share of all articles is one row, not a skewed join partition."""
    per = (driver.articles(spark, d, with_path=False).groupBy("edition_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("content_size").alias("bytes")))
    e = driver.editions(spark, d).select("edition_id", *edition_cols)
    return per.join(e, "edition_id", "left")


def articles_with_editions(spark: SparkSession, d: str, edition_cols=("publication_date",),
                           with_path: bool = False) -> DataFrame:
    """Articles left-join editions on the edition key, carrying only ``edition_cols``."""
    a = driver.articles(spark, d, with_path=with_path)
    e = driver.editions(spark, d).select("edition_id", *edition_cols)
    return a.join(e, "edition_id", "left")


# --------------------------------------------------------------------------- editions

def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    """A2: one row of corpus totals."""
    e = editions_with_counts(spark, d)
    return e.agg(
        F.count(F.lit(1)).alias("n_editions"),
        F.min("publication_date").alias("first_date"),
        F.max("publication_date").alias("last_date"),
        F.sum(F.col("supplement").cast("bigint")).alias("n_supplements"),
        round_half_up(F.avg(F.col("supplement").cast("double")) * 100.0, 1).alias("pct_supplement"),
        F.sum("num_articles").alias("n_articles"),
        round_half_up(F.avg("num_articles"), 1).alias("mean_articles_per_edition"),
    )


def by_type(spark: SparkSession, d: str) -> DataFrame:
    """A3 + T1: per edition type, ordered by count desc (tie: name)."""
    return (editions_with_counts(spark, d).groupBy("edition_type_name")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg("num_articles").alias("avg_articles"),
                 F.sum("num_articles").alias("total_articles"))
            .orderBy(F.desc("count"), "edition_type_name"))


def by_year(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    e = driver.editions(spark, d)
    return (e.groupBy(F.year("publication_date").alias("year"))
             .agg(F.count(F.lit(1)).alias("count")).orderBy("year"))


def by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Editions per year and quarter."""
    e = driver.editions(spark, d)
    return (e.groupBy(F.year("publication_date").alias("year"), quarter("publication_date").alias("quarter"))
             .agg(F.count(F.lit(1)).alias("count")))


def by_month(spark: SparkSession, d: str) -> DataFrame:
    """A5: seasonality across all years."""
    e = driver.editions(spark, d)
    return (e.groupBy(F.month("publication_date").alias("month"))
             .agg(F.count(F.lit(1)).alias("count")).orderBy("month"))


def by_weekday_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """A6 + J12: ISO weekday 1..7 with zero fill. The 7-row weekday dimension is
    fixed-size, so it is broadcast."""
    e = driver.editions(spark, d)
    counts = e.groupBy(iso_weekday("publication_date").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    days = F.broadcast(spark.createDataFrame([(i + 1, lbl) for i, lbl in enumerate(WEEKDAY_LABELS)],
                                             "weekday int, label string"))
    return (days.join(counts, "weekday", "left")
                .select("weekday", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
                .orderBy("weekday"))


def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """A7 + P27."""
    e = driver.editions(spark, d)
    g = (e.groupBy(F.year("publication_date").alias("year"), F.month("publication_date").alias("month"))
          .agg(F.count(F.lit(1)).alias("count")))
    return g.withColumn("year_month", year_month("year", "month")).orderBy("year", "month")


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """Articles per publication day (dates that fail to parse are dropped)."""
    a = per_edition_with(spark, d)
    return (a.where(F.col("publication_date").isNotNull())
             .groupBy(F.col("publication_date").alias("date")).agg(F.sum("n").alias("count"))
             .orderBy("date"))


# --------------------------------------------------------------------------- articles

def articles_overview(spark: SparkSession, d: str) -> DataFrame:
    """A8 + A26 + P25."""
    a = driver.articles(spark, d, with_path=False)
    return a.agg(
        F.count(F.lit(1)).alias("n_articles"),
        round_half_up(F.avg("depth"), 2).alias("mean_depth"),
        F.max("depth").alias("max_depth"),
        round_half_up(kib(F.avg("content_size")), 1).alias("mean_kb"),
        round_half_up(gib(F.sum("content_size")), 2).alias("total_gb"),
        F.sum("content_size").alias("total_bytes"),
    )


def by_content_type(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean KB (2 dp), total GB (3 dp), ordered by count desc."""
    a = driver.articles(spark, d, with_path=False)
    return (a.groupBy("content_type")
             .agg(F.count(F.lit(1)).alias("count"),
                  round_half_up(kib(F.avg("content_size")), 2).alias("avg_size_kb"),
                  round_half_up(gib(F.sum("content_size")), 3).alias("total_size_gb"))
             .orderBy(F.desc("count"), "content_type"))


def type_share(spark: SparkSession, d: str) -> DataFrame:
    """Content-type distribution with its share of all articles. The total is a
    scalar subquery (one extra aggregate job, no join)."""
    a = driver.articles(spark, d, with_path=False)
    total = a.agg(F.count(F.lit(1))).scalar()
    return (a.groupBy("content_type").agg(F.count(F.lit(1)).alias("count"))
             .withColumn("share", F.col("count") / total)
             .orderBy(F.desc("count"), "content_type"))


def depth_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    a = driver.articles(spark, d, with_path=False)
    return a.groupBy("depth").agg(F.count(F.lit(1)).alias("count")).orderBy("depth")


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed; min == max puts
    everything in bin 0. min and max come from one scalar subquery (one extra scan)."""
    bounds = df.agg(F.struct(F.min(value).alias("mn"), F.max(value).alias("mx"))).scalar()
    mn, mx = bounds.getField("mn"), bounds.getField("mx")
    width = (mx - mn) / F.lit(float(bins))
    b = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - mn) * bins / (mx - mn)), F.lit(bins - 1))).cast("int")
    return (df.select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
              .select("bin", (mn + F.col("bin") * width).alias("lo"),
                      (mn + (F.col("bin") + 1) * width).alias("hi"), "count")
              .orderBy("bin"))


def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A12 on article size in KB, 50 bins."""
    a = driver.articles(spark, d, with_path=False).select(kib("content_size").alias("size_kb"))
    return equal_width_histogram(a, "size_kb", HISTOGRAM_BINS_KB)


def size_histogram_bytes(spark: SparkSession, d: str) -> DataFrame:
    """A12 on article size in bytes, 40 bins."""
    a = driver.articles(spark, d, with_path=False).select(F.col("content_size").cast("double").alias("size"))
    return equal_width_histogram(a, "size", HISTOGRAM_BINS_BYTES)


def top_largest(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """T2 + P26: the n largest articles; a top-k, planned as TakeOrderedAndProject
    (per-partition top-n, then a final merge of n rows each). article_id is not unique
    in the driver data, so identifier and protocol complete the tie-break."""
    a = driver.articles(spark, d)
    return (a.orderBy(F.desc("content_size"), "article_id", "identifier", "protocol").limit(n)
             .select("article_id", "content_size", ellipsize("title", 40, 37).alias("title"),
                     round_half_up(mib("content_size"), 4).alias("size_mb")))


# --------------------------------------------------------------------------- combined

def articles_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Flagship (J6 + A19 + A24): articles and bytes per publication year."""
    a = per_edition_with(spark, d)
    return (a.groupBy(F.year("publication_date").alias("year"))
             .agg(F.sum("n").alias("num_articles"),
                  F.sum("bytes").alias("total_size"))
             .withColumn("total_size_gb", round_half_up(gib("total_size"), 6))
             .orderBy("year"))


def articles_per_month(spark: SparkSession, d: str) -> DataFrame:
    """Article counts per publication month (all years)."""
    a = per_edition_with(spark, d)
    return (a.groupBy(F.month("publication_date").alias("month")).agg(F.sum("n").alias("count"))
             .orderBy("month"))


def edition_article_lists(spark: SparkSession, d: str) -> DataFrame:
    """A31 on request (not registered as a whole-corpus query): each edition with the
    ordered list of its article ids (empty for editions without articles). A list holds
    one edition's articles in one row, so it is meant for bounded selections (a date
    range, a batch), as ``quire.plans.query.iter_editions`` uses it. Lists are per edition, so
    their length is one gazette's article count."""
    from quire.operators.assemble import edition_article_lists as lists
    e = driver.editions(spark, d).select("edition_id", "publication_date")
    a = driver.articles(spark, d, with_path=False)
    out = lists(e, a, key=("edition_id",), fields=("article_id",), order=("article_id", "protocol"))
    return out.select("edition_id", "publication_date",
                      F.transform("articles", lambda x: x["article_id"]).alias("article_ids"),
                      F.size("articles").alias("n_articles"))


def articles_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    a = per_edition_with(spark, d, ("edition_type_name",))
    return (a.groupBy("edition_type_name").agg(F.sum("n").alias("count"))
             .orderBy(F.desc("count"), "edition_type_name"))


def supplement_stats(spark: SparkSession, d: str) -> DataFrame:
    """Regular vs supplement editions."""
    a = per_edition_with(spark, d, ("supplement",))
    return (a.groupBy("supplement")
             .agg(F.sum("n").alias("num_articles"),
                  round_half_up(kib(F.sum("bytes").cast("double") / F.sum("n")), 3).alias("avg_size_kb"))
             .orderBy("supplement"))


def articles_suffixed_join(spark: SparkSession, d: str) -> DataFrame:
    """J7 + P28: articles left-join editions; the colliding column gets the
    ``_article`` / ``_edition`` suffixes (the article side's own date is its ship date)."""
    li = driver.table(spark, d, "lineitem")
    a = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"),
                  F.col("l_orderkey").alias("edition_id"),
                  F.to_date("l_shipdate").alias("publication_date_article"))
    e = driver.editions(spark, d).select("edition_id", F.col("publication_date").alias("publication_date_edition"),
                                         "edition_type_name")
    return a.join(e, "edition_id", "left")


def executive_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row. Each figure is an independent aggregate combined as scalar
    subqueries; the modal weekday / dominant type / top paths are taken from
    aggregated rows with a deterministic tie-break."""
    e = driver.editions(spark, d)
    a = driver.articles(spark, d)
    wd = (e.groupBy(iso_weekday("publication_date").alias("wd")).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max_by("wd", F.struct("n", -F.col("wd"))).alias("m")))
    ct = (a.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max_by("content_type", F.struct("n", F.col("content_type"))).alias("m")))
    paths = (a.groupBy(path_label("hierarchy_path").alias("p")).agg(F.count(F.lit(1)).alias("n")))
    top3 = (paths.orderBy(F.desc("n"), "p").limit(3)
                 .agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("p")))).alias("s"))
                 .select(F.transform("s", lambda x: x.getField("p")).alias("top")))
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    es = e.agg(F.struct(F.count(F.lit(1)).alias("n"),
                        F.countDistinct(F.year("publication_date")).alias("years"))).scalar()
    ne, ny = es.getField("n"), es.getField("years")
    at = a.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("depth"))).scalar()
    na = at.getField("n")
    row = spark.range(1).select(
        ne.alias("n_editions"),
        na.alias("n_articles"),
        round_half_up(ne / ny, 0).alias("editions_per_year"),
        round_half_up(na / ne, 1).alias("articles_per_edition"),
        F.element_at(labels, wd.select("m").scalar()).alias("modal_weekday"),
        ct.select("m").scalar().alias("dominant_content_type"),
        round_half_up(at.getField("depth"), 2).alias("mean_depth"),
        paths.agg(F.count(F.lit(1))).scalar().alias("n_distinct_paths"),
        top3.select("top").scalar().alias("top_paths"),
    )
    return row


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of depth, content_size, year, month, day. One aggregate
    computes each unordered pair once (10 corr + 5 stddev) and the 25 cells are mirrored
    from it; constant columns give NULL instead of a division error."""
    cols = ["depth", "content_size", "year", "month", "day"]
    a = articles_with_editions(spark, d).select(
        "depth", "content_size", F.year("publication_date").alias("year"),
        F.month("publication_date").alias("month"), F.dayofmonth("publication_date").alias("day"))
    aggs = [F.stddev_pop(c).alias(f"sd_{c}") for c in cols]
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1:]]
    aggs += [F.corr(x, y).alias(f"r_{x}_{y}") for x, y in pairs]
    wide = a.agg(*aggs)

    def cell(x, y):
        if x == y:
            return F.when(F.col(f"sd_{x}") > 0, F.lit(1.0))
        r = f"r_{x}_{y}" if (x, y) in pairs else f"r_{y}_{x}"
        return F.when((F.col(f"sd_{x}") > 0) & (F.col(f"sd_{y}") > 0), F.col(r))

    stack = F.stack(F.lit(len(cols) ** 2), *[e for x in cols for y in cols
                                             for e in (F.lit(x), F.lit(y), cell(x, y))])
    return wide.select(stack.alias("col_a", "col_b", "corr")).select(
        "col_a", "col_b", round_half_up("corr", 6).alias("corr"))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Dtype and non-null count per article column, from one aggregate."""
    a = driver.articles(spark, d)
    fields = a.schema.fields
    wide = a.agg(*[F.count(f.name).alias(f.name) for f in fields])
    stack = F.stack(F.lit(len(fields)), *[e for f in fields
                                          for e in (F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f.name))])
    return wide.select(stack.alias("column", "dtype", "non_null"))
