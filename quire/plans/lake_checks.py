"""Registered queries that write a lake into the shared folder and read it back.

Each call takes a fresh folder below ``spark.checkpoint.dir``; the frame that it returns reads
what was written there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.rows import keep_where
from quire.functions.urls import host, path
from quire.operators import assemble as A
from quire.operators import content as C
from quire.plans.ingest import build_corpus, frontier_urls
from quire.session import ensure_checkpoint_dir
from quire.sinks import lake
from quire.sources import driver
from quire.sources.files import list_files, read_parquets


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def lake_round_trip(spark, d):
    """S9 + S10 + K5 + K6 + A28 + §2.10 url: the corpus written by year, then for every folder of
    the three tables its rows (from the lineage column), whether files are listed there, the
    host of its PDF links, and the rows of its table (from the storage statistics)."""
    root = _fresh(spark, "round-trip")
    lake.write_corpus(spark, build_corpus(spark, d), root, "b1", granularity="year")
    stats = lake.storage_stats(spark, root).select("table", F.col("rows").alias("table_rows"))
    folder = lambda c, name: F.regexp_extract(c, f".*/{name}/(.*)/[^/]*$", 1)
    out = None
    for name in ("editions", "articles", "relationships"):
        rows = read_parquets(spark, f"{root}/{name}")
        link = host(F.col("pdf_url")) if name == "editions" else F.lit(None).cast("string")
        rows = (rows.groupBy(folder(F.col("__source_file__"), name).alias("path"))
                .agg(F.count(F.lit(1)).alias("n_rows"), F.max(link).alias("host"), F.count_distinct(link).cast("int").alias("n_hosts")))
        files = list_files(spark, f"{root}/{name}", ".parquet").groupBy(folder(F.col("path"), name).alias("path")).agg(
            (F.min("length") > 0).alias("has_files"))
        part = rows.join(files, "path", "full").withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(stats, "table").select("table", "path", "n_rows", "has_files", "host", "n_hosts", "table_rows")


def frontier_hosts(spark, d):
    """§2.10 url: hosts and path shapes of the crawl frontier, with the requests of each."""
    u = frontier_urls(spark, d)
    shape = F.regexp_replace(path(F.col("url")), "[0-9]+", "#")
    return u.groupBy("phase", "municipality", host(F.col("url")).alias("host"), shape.alias("path_shape")).agg(F.count(F.lit(1)).alias("n_requests"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return C.split_inline(C.dispatch(driver.content_responses(spark, d)))


def blob_append(spark, d):
    """K4 + J11 + R4: two batches appended to a content store: the English and French documents,
    then all of them. Every stored blob with the batch that brought it."""
    root, both = _fresh(spark, "blob-append"), _split(spark, d)
    docs = driver.content_responses(spark, d)
    first = docs.where(F.col("content_type_header").isin(driver.LANG_CONTENT_HEADER["en"], driver.LANG_CONTENT_HEADER["fr"]))
    lake.append_content(spark, C.split_inline(C.dispatch(first)), root, "b1")
    lake.append_content(spark, both, root, "b2")
    return lake.read_table(spark, root, "content").select(
        "content_hash", "batch_id", "prefix", "content_size", F.sha2("content", 256).alias("stored_hash"))


def content_bodies(spark, d):
    """The stored body of every out-of-line article, joined back by hash."""
    root = _fresh(spark, "bodies")
    lake.append_content(spark, _split(spark, d), root, "b1")
    a = build_corpus(spark, d).articles.select("article_id", "content_hash")
    refs = keep_where(a, F.col("content_hash").isNotNull())
    return lake.read_content(spark, root, refs).select(
        "article_id", "content_hash", F.octet_length("content").cast("bigint").alias("n_bytes"),
        (F.sha2("content", 256) == F.col("content_hash")).alias("intact"))


def edition_article_chunks(spark, d, size: int = 4):
    """The article list of every edition in chunks of ``size``, as parallel arrays."""
    a = driver.articles(spark, d, with_path=False).select("edition_id", "article_id", "protocol", "identifier", "depth")
    c = A.edition_article_chunks(a, key=("edition_id",), fields=("article_id", "protocol", "identifier", "depth"),
                                 order=("article_id", "protocol"), size=size)
    return c.select("edition_id", "chunk", "n_articles", F.col("articles.article_id").alias("article_ids"),
                    F.col("articles.identifier").alias("identifiers"))
