"""The ingest pipeline as one lazy plan, and the registered ingest queries.

    structure links -> reject NULL identifiers -> keep-deepest dedupe (J1)
                    -> join landed content by identifier (J5) -> dispatch/split (P11-P14)
                    -> per-edition counts (J2/A1) -> edition hash (P15)
                    -> editions / articles / relationships / content tables (K1-K4)

On the driver tables the structure links are ``lineitem`` rows (see
``quire.sources.driver``), content responses are ``documents``. Shuffles: the dedupe
(on municipality+identifier), the content join (on identifier), the edition count (on
edition) and the blob dedupe (on hash, narrow first).
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import ISO_DATE, date_parts
from quire.functions.rows import keep_where
from quire.functions.text import path_to_json
from quire.operators import assemble as A
from quire.operators import content as C
from quire.operators import editions as E
from quire.operators import fetchlog as FL
from quire.operators import frontier as FR
from quire.sources import driver
from quire.sources.files import delete_path
from quire.sources.portals import portals


COLUMNS = {
    "editions": ("municipality", "edition_id", "publication_date", "edition_number", "supplement", "edition_type_id",
                 "edition_type_name", "pdf_url", "total_articles", "edition_hash"),
    "articles": ("municipality", "article_id", "edition_id", "edition_hash", "publication_date", "title", "hierarchy_path",
                 "hierarchy_path_json", "identifier", "protocol", "depth", "content_type", "content_size", "content_hash",
                 "content_path", "inline_text"),
    "relationships": ("municipality", "edition_id", "article_id", "edition_hash", "publication_date"),
}


class Corpus:
    """J1-J5 + K1-K3 from parsed parts, built lazily: each table is constructed on first
    access, so a query that needs one table does not plan the others.

    editions_in: municipality, edition_id, publication_date, edition_number, supplement,
                 edition_type_id, edition_type_name (one row per edition)
    links:       municipality, edition_id, article_id, identifier, title, protocol, depth,
                 hierarchy_path + the ``order`` columns giving first-seen order (one row
                 per extracted link, duplicates allowed)
    split:       content responses after dispatch + split (request_key = identifier). An
                 identifier is unique within its portal: with a ``municipality`` column, a
                 response belongs to that portal's articles alone; without one, to all portals'
    describe:    where given, links come without title and hierarchy_path, and it adds both to the
                 deduplicated ones, so the dedupe moves narrow rows
    """

    def __init__(self, spark: SparkSession, editions_in: DataFrame, links: DataFrame, split: DataFrame,
                 order=("ord",), describe=None):
        self.spark, self._editions_in, self._links, self._split = spark, editions_in, links, split
        self._order, self._describe = list(order), describe

    def materialize(self, fallback: str | None = None) -> "Corpus":
        """Store what the three tables share, as Parquet in the session's
        ``spark.checkpoint.dir`` (``fallback`` where that is unset: a folder every executor
        shares): the deduplicated links, and the editions with their counts. Neither holds a
        body. Writing the editions, articles and relationships tables then reads them instead of
        re-running the pipeline three times, and a lost executor recomputes from the files.
        `release` deletes them."""
        from quire.session import ensure_checkpoint_dir
        self.release()
        self._folder = f"{ensure_checkpoint_dir(self.spark, fallback).rstrip('/')}/corpus-{uuid.uuid4().hex[:12]}"
        # an article's own stand-in content columns (if any) give way to the fetched content
        self.__dict__["_unique"] = self._store(self._unique.drop("content_type", "content_size"), "links")
        self.__dict__["_counted"] = self._store(self._counted, "editions")
        return self

    _folder = None

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self._folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self._folder}/{name}")

    def release(self) -> None:
        """Delete what `materialize` stored; the tables are computed from the inputs again."""
        for name in [n for n, v in vars(type(self)).items() if isinstance(v, cached_property)]:
            self.__dict__.pop(name, None)
        if self._folder is not None:
            delete_path(self.spark, self._folder)
            self._folder = None

    def _with_content(self, links: DataFrame, responses: DataFrame) -> DataFrame:
        """``links`` with the response to their request: equal identifier, equal portal."""
        keys = responses.withColumnRenamed("request_key", "_rk").withColumn("_rk", F.col("_rk").cast("string"))
        cond = F.col("identifier").cast("string") == F.col("_rk")
        if "municipality" in responses.columns:
            keys = keys.withColumnRenamed("municipality", "_rm")
            cond = cond & (F.col("municipality") == F.col("_rm"))
        return links.join(keys, cond).drop("_rk", "_rm")

    @cached_property
    def _request_key(self) -> list[str]:
        return [c for c in ("municipality", "request_key") if c in self._split.columns]

    @cached_property
    def content_split(self) -> DataFrame:
        """Valid content responses after dispatch + split (no reason column)."""
        return keep_where(self._split, F.col("reason").isNull()).drop("reason")

    @cached_property
    def content(self) -> DataFrame:
        """Blob metadata: (hash, path, size, references)."""
        return C.blob_refs(self.content_split)

    @cached_property
    def _unique(self) -> DataFrame:
        """One link for each identifier of a portal."""
        unique = A.dedupe_keep_deepest(self._links.where(F.col("identifier").isNotNull()), order=self._order)
        return unique if self._describe is None else self._describe(unique)

    @cached_property
    def _articles_core(self) -> DataFrame:
        # an article's own stand-in content columns (if any) give way to the fetched content
        return self._with_content(self._unique.drop("content_type", "content_size"), self._content_cols)

    @cached_property
    def _content_cols(self) -> DataFrame:
        return self.content_split.select(*self._request_key, "content_type", "content_size", "content_hash",
                                         "content_path", "inline_text")

    def counted(self, obs) -> "Corpus":
        """This corpus, with the number of articles that have content observed while the
        editions are built."""
        other = Corpus(self.spark, self._editions_in, self._links, self._split, self._order, self._describe)
        other._observe = obs
        return other

    _observe = None

    @cached_property
    def _edition_counts(self) -> DataFrame:
        """Articles per edition. Counting needs no body: Spark prunes the dedupe to its keys and
        the responses to theirs, and where the rows need no more than that, both share the
        exchanges below."""
        valid = keep_where(self._split.select(*self._request_key, "reason"), F.col("reason").isNull()).drop("reason")
        kept = self._with_content(self._unique, valid)
        if self._observe is not None:
            kept = kept.observe(self._observe, F.count(F.lit(1)).alias("rows"))
        return kept.groupBy(*A.EDITION_KEY).agg(F.count(F.lit(1)).alias("_n"))

    @cached_property
    def _counted(self) -> DataFrame:
        """Editions with their article count, not yet hashed."""
        eds = self._editions_in.withColumn("publication_date_str", F.date_format("publication_date", ISO_DATE))
        eds = E.with_pdf_url(eds, self.spark)
        return (eds.join(self._edition_counts, list(A.EDITION_KEY), "left")
                   .withColumn("total_articles", F.coalesce("_n", F.lit(0)).cast("int")).drop("_n"))

    @cached_property
    def _eds(self) -> DataFrame:
        return A.with_edition_hash(self._counted)

    def rows(self, name: str) -> DataFrame:
        """A table without what `finished` derives from the rest of a row."""
        if name == "editions":
            return self._counted.drop("publication_date_str").select("*", *date_parts("publication_date"))
        e_keys = self._counted.select(*A.EDITION_KEY, "publication_date", "total_articles")
        if self._folder is None:
            found = self._articles_core.join(e_keys, list(A.EDITION_KEY))
        else:  # bodies come last: the join to the editions moves none
            found = self._with_content(self._unique.join(e_keys, list(A.EDITION_KEY)), self._content_cols)
        if name == "relationships":
            found = found.select(*A.EDITION_KEY, "article_id", "publication_date", "total_articles")
        else:
            found = found.drop("_n", "publication_date_str")
        return found.select("*", *date_parts("publication_date"))

    @staticmethod
    def finished(rows: DataFrame, name: str, *more: str) -> DataFrame:
        """The columns of a table from its `rows` (and ``more`` of theirs). Row by row: behind an
        exchange it saves what does not compress there, as digests and repeated paths."""
        out = A.with_edition_hash(rows.withColumn("publication_date_str", F.date_format("publication_date", ISO_DATE)))
        text = {c: F.col(c).cast("string").alias(c) for c in ("edition_id", "article_id", "identifier")}
        derived = text | {"hierarchy_path_json": path_to_json("hierarchy_path").alias("hierarchy_path_json"),
                          "protocol": F.coalesce("protocol", F.lit("")).alias("protocol")}
        return out.select(*[derived.get(c, c) for c in (*COLUMNS[name], "year", "month", "day", *more)])

    @cached_property
    def editions(self) -> DataFrame:
        return self.finished(self.rows("editions"), "editions")

    @cached_property
    def articles(self) -> DataFrame:
        # the hash is taken behind the join: a digest does not compress in the exchange
        return self.finished(self.rows("articles"), "articles")

    @cached_property
    def relationships(self) -> DataFrame:
        return self.finished(self.rows("relationships"), "relationships")

    @cached_property
    def totals(self) -> DataFrame:
        """One row of run totals (K10) from two aggregates: editions with their counts, and
        blob references. An article is a row of an edition, so their number is the counts' sum."""
        none = F.lit(None).cast("bigint")
        e = self._eds.agg(F.count(F.lit(1)).alias("n_editions"), F.coalesce(F.sum("total_articles"), F.lit(0)).alias("n_articles"),
                          F.count_if(F.col("total_articles") == 0).alias("n_empty_editions"))
        b = self.content.agg(F.count(F.lit(1)).alias("n_blobs"), F.sum("content_size").alias("blob_bytes"))
        both = e.select("*", none.alias("n_blobs"), none.alias("blob_bytes")).unionByName(
            b.select(*[none.alias(c) for c in e.columns], "*"))
        names = ("n_editions", "n_articles", "n_empty_editions", "n_blobs", "blob_bytes")
        t = both.agg(*[F.sum(c).alias(c) for c in names])
        return t.select("n_editions", "n_articles", F.col("n_articles").alias("n_relationships"), "n_empty_editions", "n_blobs", "blob_bytes")

    @cached_property
    def rejects(self) -> DataFrame:
        structure = (self._links.where(F.col("identifier").isNull())
                         .select("municipality", F.lit("structure").alias("phase"),
                                 F.col("article_id").cast("string").alias("request_key"),
                                 F.lit("missing_identifier").alias("reason")))
        bad_content = keep_where(self._split, F.col("reason").isNotNull())
        return structure.unionByName(
            bad_content.select((F.col("municipality") if "municipality" in self._split.columns
                                else F.lit(None).cast("string")).alias("municipality"), F.lit("content").alias("phase"),
                               F.col("request_key").cast("string").alias("request_key"), "reason"))


def structure_links(spark: SparkSession, d: str, with_path: bool = True) -> DataFrame:
    """Extracted article links with their edition's municipality."""
    a = driver.articles(spark, d, with_path=with_path)
    em = driver.edition_municipality(spark, d)
    return a.join(em, "edition_id")


def assemble_corpus(spark: SparkSession, editions: DataFrame, links: DataFrame, split: DataFrame,
                    order=("ord",), describe=None) -> Corpus:
    """See :class:`Corpus`."""
    return Corpus(spark, editions, links, split, order, describe)


def build_corpus(spark: SparkSession, d: str) -> Corpus:
    """The pipeline over the driver tables (see the module docstring). A document answers the
    request for its key on every portal, so the responses go in without their portal."""
    links = structure_links(spark, d, with_path=False).where(F.col("identifier").isNotNull())
    split = C.split_inline(C.dispatch(driver.content_responses(spark, d).drop("municipality")))
    eds = driver.editions_full(spark, d)
    # first-seen order: article_id is not unique in the driver data, protocol completes it
    return assemble_corpus(spark, eds, links, split, order=("article_id", "protocol"),
                           describe=lambda unique: driver.with_path(spark, d, unique))


# --------------------------------------------------------------------------- registered queries

def editions_table(spark, d):
    """K1 (+ P7, P15, P16, J2): the editions table without run/clock columns."""
    return build_corpus(spark, d).editions


def articles_table(spark, d):
    """K2 (+ J1, J5, P11-P14, P19, P20): the articles table without run/clock columns."""
    return build_corpus(spark, d).articles.drop("hierarchy_path")


def relationships_table(spark, d):
    """K3."""
    return build_corpus(spark, d).relationships


def edition_hash(spark, d):
    """P15 + P16: hash and date parts per edition."""
    return build_corpus(spark, d).editions.select("edition_id", "total_articles", "edition_hash",
                                                  "year", "month", "day")


def content_split(spark, d):
    """P11-P14 per landed content response (text columns left out)."""
    return build_corpus(spark, d).content_split.select(
        "request_key", "content_type", "char_length", "content_size", "is_blob", "content_hash", "content_path")


def content_blobs(spark, d):
    """K4 + K7: one row per stored blob."""
    return build_corpus(spark, d).content


def content_lookup(spark, d):
    """Out-of-line articles joined to the blob store by hash."""
    a = build_corpus(spark, d).articles  # path and size are on the article already
    return keep_where(a.select("article_id", "content_hash", "content_path", "content_size"), F.col("content_hash").isNotNull())


def summary_metrics(spark, d):
    """One row of run totals."""
    return build_corpus(spark, d).totals


def dedupe_keep_deepest(spark, d):
    """J1 + U3 over the raw links, keyed by identifier."""
    a = driver.articles(spark, d)
    return (A.dedupe_keep_deepest(a, key=("identifier",), order=("article_id", "protocol"))
             .select("identifier", "article_id", "edition_id", "depth", "hierarchy_path"))


def dedupe_stats(spark, d):
    """A30."""
    return A.duplicates_removed(driver.articles(spark, d, with_path=False), key=("identifier",))


def edition_article_counts(spark, d):
    """J2 + A1: every edition with its article count, zeros included."""
    return A.with_article_counts(driver.editions(spark, d).select("edition_id"),
                                 driver.articles(spark, d, with_path=False),
                                 key=("edition_id",), name="num_articles")


def orphan_articles(spark, d):
    """Articles whose edition is unknown, while only the regular editions (no
    supplements) have been stored."""
    stored = driver.editions(spark, d).where(~F.col("supplement"))
    return A.orphan_articles(driver.articles(spark, d, with_path=False), stored,
                             key=("edition_id",)).select("article_id", "edition_id")


def empty_editions(spark, d):
    """Editions without articles."""
    return A.empty_editions(driver.editions(spark, d), driver.articles(spark, d, with_path=False),
                            key=("edition_id",)).select("edition_id", "publication_date")


def editions_in_range(spark, d, start: str = "1996-01-01", end: str = "1996-12-31"):
    """Editions of a date range with their article counts."""
    e = driver.editions(spark, d).where(F.col("publication_date").between(F.lit(start).cast("date"),
                                                                         F.lit(end).cast("date")))
    return A.with_article_counts(e.select("edition_id", "publication_date", "edition_type_name"),
                                 driver.articles(spark, d, with_path=False), key=("edition_id",),
                                 name="num_articles")


def rolling_window(spark, d, days: int = 7):
    """editions of the last ``days`` days, the window ending at the newest edition."""
    e = driver.editions(spark, d)
    end = e.agg(F.max("publication_date")).scalar()
    return (e.where((F.col("publication_date") <= end) & (F.col("publication_date") >= F.date_sub(end, days - 1)))
             .select("edition_id", "publication_date", "edition_type_name"))


def scan_projection(spark, d):
    """S7 + S8: a two-column projection: the scan's ReadSchema holds only those."""
    return driver.editions(spark, d).select("edition_id", "publication_date")


def calendar_weekdays(spark, d):
    """S2 + J10: weekdays of the corpus date span minus fixed-date holidays."""
    e = driver.editions(spark, d)
    span = e.agg(F.min("publication_date").alias("start_date"), F.max("publication_date").alias("end_date"))
    years = span.select(F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("y"))
    hol = years.select(F.explode(F.array(*[F.lit(h) for h in FR.FIXED_HOLIDAYS])).alias("md"), "y").select(
        F.make_date("y", F.substring("md", 1, 2).cast("int"), F.substring("md", 4, 2).cast("int")).alias("d"))
    return FR.weekdays(span, hol).select("d", (F.weekday("d") + 1).alias("iso_weekday"))


def frontier_urls(spark, d):
    """S1 + S3-S5: metadata requests per portal weekday, structure requests per edition,
    content requests per (portal, identifier)."""
    eds = driver.editions_full(spark, d).select("edition_id", "publication_date", "municipality")
    ranges = eds.groupBy("municipality").agg(F.min("publication_date").alias("start_date"),
                                             F.max("publication_date").alias("end_date"))
    meta = FR.metadata_frontier(spark, ranges).withColumn("phase", F.lit("metadata"))
    dom = portals(spark).select(F.col("name").alias("municipality"), "domain_url")
    struct = (eds.join(dom, "municipality")
                 .select(F.lit("structure").alias("phase"), "municipality",
                         F.col("edition_id").cast("string").alias("request_key"),
                         FR.structure_url(F.col("domain_url"), F.col("edition_id")).alias("url")))
    ids = (driver.articles(spark, d, with_path=False).select("edition_id", "identifier")
                 .join(eds.select("edition_id", "municipality"), "edition_id").select("municipality", "identifier").distinct())
    content = (ids.join(dom, "municipality")
                  .select(F.lit("content").alias("phase"), "municipality",
                          F.col("identifier").cast("string").alias("request_key"),
                          FR.content_url(F.col("domain_url"), F.col("identifier")).alias("url")))
    return meta.select("phase", "municipality", "request_key", "url").unionByName(struct).unionByName(content)


def pdf_urls(spark, d):
    """Per-portal PDF link (D5) and the original fixed-host form."""
    e = driver.editions_full(spark, d).select("edition_id", "municipality")
    compat = E.with_pdf_url(e, spark, compat=True).withColumnRenamed("pdf_url", "pdf_url_compat")
    return E.with_pdf_url(compat, spark).select("edition_id", "municipality", "pdf_url", "pdf_url_compat")


def union_sources(spark, d):
    """One landing table from three differently-shaped response sources
    (unionByName with missing columns), summarised per phase."""
    meta = driver.payloads(spark, d).select(F.lit("metadata").alias("phase"),
                                            F.col("request_key"), F.col("payload").alias("body_text"))
    pages = driver.table(spark, d, "pages").select(F.lit("structure").alias("phase"),
                                                   F.col("page_id").alias("request_key"), "url",
                                                   F.col("html").alias("body_text"))
    docs = driver.table(spark, d, "documents").select(F.lit("content").alias("phase"),
                                                      F.col("doc_id").alias("request_key"),
                                                      F.col("source").alias("municipality"),
                                                      F.col("text").alias("body_text"))
    landed = meta.unionByName(pages, allowMissingColumns=True).unionByName(docs, allowMissingColumns=True)
    return landed.groupBy("phase").agg(F.count(F.lit(1)).alias("n_responses"),
                                       F.sum(F.octet_length("body_text")).cast("bigint").alias("n_bytes"),
                                       F.count("url").alias("n_with_url"),
                                       F.count("municipality").alias("n_with_municipality"))


def request_response_join(spark, d):
    """J5 + F2: content requests (distinct identifiers of each portal) aligned with landed
    responses by portal and key; requests without a response get status 404 and no size."""
    req = structure_links(spark, d, with_path=False).select("municipality", F.col("identifier").alias("request_key")).distinct()
    resp = C.split_inline(C.dispatch(driver.content_responses(spark, d))).select(
        "municipality", "request_key", F.lit(200).alias("status"), "content_size")
    j = A.response_join(req, resp)
    return j.select("municipality", "request_key", F.coalesce("status", F.lit(404)).alias("status"), "content_size",
                    FL.is_success(F.coalesce("status", F.lit(404))).alias("ok"))


def retry_triage(spark, d):
    """F3 + F4: retry schedule for every retryable failure in the fetch log."""
    return FL.retry_schedule(driver.fetch_log(spark, d)).select(
        "fetch_id", "status", "action", "attempt", "next_attempt", "wait_s")


def fetch_success_ratio(spark, d):
    """Share of successful fetches per day."""
    log = driver.fetch_log(spark, d).withColumn("day", F.to_date("fetched_at"))
    return FL.success_ratio(log, ["day"])


def json_field_counts(spark, d):
    """P1 (SQL form): top-level fields of the JSON payloads with value statistics."""
    p = driver.payloads(spark, d)
    kv = p.select(F.explode(F.from_json("payload", "map<string,string>")).alias("field", "value"))
    return kv.groupBy("field").agg(F.count(F.lit(1)).alias("n_payloads"),
                                   F.countDistinct("value").alias("n_distinct"),
                                   F.min(F.col("value").try_cast("double")).alias("min_value"),
                                   F.max(F.col("value").try_cast("double")).alias("max_value"))


def edition_payloads_landed(spark, d) -> DataFrame:
    """Every edition landed as a metadata JSON payload (request_key = edition id). Field
    types drift by order status as they do across the real portals: numbers, numeric
    strings, and '' / 0 / 1 supplements."""
    o = driver.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                                "o_orderpriority")
    type_id = F.substring("o_orderpriority", 1, 1).cast("int")
    item_f = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit(1).alias("suplemento"),
                                F.col("o_custkey").alias("numero"), type_id.alias("tipo_edicao_id"),
                                F.col("o_orderpriority").alias("tipo_edicao_nome")))
    item_o = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(0).alias("suplemento"),
                                F.col("o_custkey").cast("string").alias("numero"),
                                type_id.cast("string").alias("tipo_edicao_id"),
                                F.col("o_orderpriority").alias("tipo_edicao_nome")))
    item_p = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit("").alias("suplemento"),
                                F.col("o_custkey").alias("numero"), type_id.alias("tipo_edicao_id"),
                                F.col("o_orderpriority").alias("tipo_edicao_nome")))
    item = F.when(F.col("o_orderstatus") == "F", item_f).when(F.col("o_orderstatus") == "O", item_o) \
            .otherwise(item_p)
    payload = F.concat(F.lit('{"erro":false,"msg":"","data":"'), F.date_format("o_orderdate", ISO_DATE),
                       F.lit('","numero":null,"itens":['), item, F.lit("]}"))
    return o.select(F.col("o_orderkey").alias("request_key"), payload.alias("payload"))


def edition_payloads(spark, d):
    """P1-P6 end to end: landed edition payloads parsed back into typed edition rows."""
    parsed, bad = E.parse_editions(edition_payloads_landed(spark, d))
    good, _ = E.split_valid(parsed, bad)
    return good.select("edition_id", "publication_date", "edition_number", "supplement",
                       "edition_type_id", "edition_type_name")


def content_charsets(spark, d):
    """Documents landed in a charset by language (with a windows-1252 sign at the end, or
    broken input where the charset has such), decoded back: length, size and hash of the text."""
    doc = driver.table(spark, d, "documents").select("doc_id", "lang", "text")
    lang, text = F.col("lang"), F.col("text")
    body = (F.when(lang == "fr", F.concat(F.encode(text, "UTF-16LE"), F.unhex(F.lit("41"))))
             .when(lang == "de", F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("80"))))
             .when(lang == "es", F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8")))
    header = (F.when(lang == "fr", "text/plain; charset=utf-16le").when(lang == "de", "text/html; charset=UTF-8")
               .when(lang == "es", "text/plain; charset=utf-16be").otherwise("text/html"))
    landed = doc.select(F.col("doc_id").alias("request_key"), header.alias("content_type_header"), body.alias("body"))
    r = C.dispatch(landed)
    return r.select("request_key", "content_type", F.char_length("text").cast("bigint").alias("n_chars"),
                    F.octet_length("bytes_").cast("bigint").alias("content_size"), F.sha2("bytes_", 256).alias("text_hash"))


def rejects_summary(spark, d):
    """P17 + J3: what would be rejected, and why: payloads without editions, articles whose
    edition is not stored (regular editions only), articles without landed content."""
    parsed, bad = E.parse_editions(driver.payloads(spark, d))
    _, meta = E.split_valid(parsed, bad)
    a = driver.articles(spark, d, with_path=False).select("edition_id", F.col("identifier").alias("request_key"))
    have = driver.table(spark, d, "documents").select(F.col("doc_id").alias("request_key"))
    parts = [meta.select(F.lit("metadata").alias("phase"), "reason"),
             orphan_articles(spark, d).select(F.lit("structure").alias("phase"), F.lit("orphan").alias("reason")),
             a.join(have, "request_key", "left_anti").select(F.lit("content").alias("phase"), F.lit("missing_content").alias("reason"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("phase", "reason").agg(F.count(F.lit(1)).alias("n_rejected"))


def nav_tree_paths(spark, d):
    """A navigation tree for every article (nested folders, link inside), parsed back:
    ids, text and folder path of its link."""
    from quire.functions.navtree import extract
    a = driver.articles(spark, d)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit('<li><a class="linkMateria" data-materia-id="'), F.col("article_id").cast("string"),
                    F.lit('" identificador="'), F.col("identifier").cast("string"), F.lit('" data-protocolo="'),
                    F.col("protocol"), F.lit('"> '), esc(F.col("title")), F.lit(" </a></li>"))
    folders = F.transform("hierarchy_path", lambda x: F.concat(F.lit('<li><span class="folder"> '), esc(x), F.lit("</span><ul>")))
    # a folder without a name leaves no page; array_join would pass over it
    tree = F.when(~F.exists("hierarchy_path", lambda x: x.isNull()), F.concat(
        F.array_join(folders, ""), link, F.repeat(F.lit("</ul></li>"), F.size("hierarchy_path"))))
    pages = a.select("edition_id", F.concat(F.lit('<div><ul><li>menu</li></ul><ul id="tree">'), tree, F.lit("</ul></div>")).alias("html"))
    return extract(pages, "html").select("edition_id", "article_id", "identifier", "protocol", "title",
                                         F.size("hierarchy_path").alias("depth"), F.concat_ws("|", "hierarchy_path").alias("path"))


def nav_links(spark, d):
    """P8 (flat form) over raw pages: links of the first <ul> of each page."""
    from quire.functions.navtree import extract
    pages = driver.table(spark, d, "pages").select("page_id", "html")
    return extract(pages, "html", "ul", "", "", "folder").select("page_id", "pos", "href")


def query_articles_base(spark, d) -> DataFrame:
    """Articles with the columns the article query filters on."""
    a = driver.articles(spark, d, with_path=False)
    e = driver.editions_full(spark, d).select("edition_id", "municipality", "publication_date")
    return a.join(e, "edition_id").select("article_id", "edition_id", "municipality", "publication_date",
                                          "content_type", "content_size")


def query_articles_filter(spark, d):
    """municipality + inclusive date range + content-type list."""
    from quire.plans.query import query_articles
    return query_articles(query_articles_base(spark, d), municipality="rj_rio_de_janeiro",
                          start_date="1996-01-01", end_date="1997-12-31", content_types=["html", "text"])


def query_articles_limit(spark, d):
    """T5: the same query with LIMIT 100 (a full ordering so the rows are defined)."""
    from quire.plans.query import query_articles
    return query_articles(query_articles_base(spark, d), municipality="rj_rio_de_janeiro",
                          start_date="1996-01-01", end_date="1997-12-31", content_types=["html", "text"],
                          limit=100, order_by=["article_id", "edition_id", "content_type", "content_size"])

