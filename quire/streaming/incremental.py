"""Incremental ingest with Structured Streaming.

Landed raw responses arrive as parquet files in a landing folder, in any grouping: a crawl's
three phases may come in one file or in many, early or late. A ``readStream`` with
``maxFilesPerTrigger`` and ``trigger(availableNow=True)`` drains what is there. Each
micro-batch

1. parses its responses once, into ``<lake>/_staging``; everything below reads that;
2. stores the phases below ``<lake>/_phases`` (editions, links, content without bodies) under
   its batch id, dealt into hash buckets of their keys, and appends new bodies to the content
   store;
3. finds the editions it touches: those it lists or has links of, and those that hold a link
   to content or to an identifier it brings. Only the buckets of its own keys are read;
4. assembles these editions from everything stored so far and writes their rows under its
   batch id, and a commit marker last. Lake reads take each edition's latest committed batch,
   so the new rows replace the old at once.

The result depends on what has landed, not on how it was grouped. A replayed micro-batch
rewrites exactly its own partitions; no streaming state is kept. One stream writes a lake at
a time (``_staging`` holds the batch in work).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quire.functions.charset import charset_of, decode_body, lenient
from quire.functions.rows import keep_where
from quire.functions.navtree import extract as extract_links
from quire.operators import assemble as A
from quire.operators import content as C
from quire.operators import editions as E
from quire.plans.ingest import assemble_corpus
from quire.sinks import lake
from quire.sources.files import path_exists, subfolders
from quire.sources.responses import RAW_SCHEMA, stream_landed  # noqa: F401  (RAW_SCHEMA re-exported)

PHASE_SCHEMAS = {
    "editions": "municipality string, edition_id string, publication_date date, edition_number int, supplement boolean, "
                "edition_type_id int, edition_type_name string, seq bigint, item_index int",
    "links": "municipality string, edition_id string, article_id string, identifier string, title string, protocol string, "
             "depth int, hierarchy_path array<string>, seq bigint, pos int",
    "edition_links": "municipality string, edition_id string, identifier string",
    "content": "municipality string, request_key string, content_type string, reason string, is_blob boolean, "
               "content_size bigint, char_length bigint, content_hash string, content_path string, inline_text string, seq bigint",
}
# The columns that give a phase's bucket. ``edition_links`` is the way from an edition to its
# identifiers, ``links`` the way from an identifier to its editions.
PHASE_KEYS = {"editions": A.EDITION_KEY, "links": A.ARTICLE_DEDUPE_KEY, "edition_links": A.EDITION_KEY,
              "content": ("municipality", "request_key")}
BUCKETS = 256  # of every phase of a lake: a batch of few keys reads few of them


def _columns(phase: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in PHASE_SCHEMAS[phase].replace("array<string>", "array").split(",")]


def parse_landed(spark: SparkSession, landed: DataFrame):
    """Parse each phase of landed responses: (editions, links, split, rejects). Bodies are
    decoded by the charset of their header; nothing in a body stops the job."""
    meta = landed.where(F.col("phase") == "metadata").select("municipality", "request_key", "seq", "content_type_header", "body")
    parsed, bad = E.parse_editions(meta, payload="body")
    editions, meta_rejects = E.split_valid(parsed, bad)

    with lenient(spark):
        struct = (landed.where(F.col("phase") == "structure")
                  .select("municipality", "edition_id", "seq",
                          decode_body(F.col("body"), charset_of(F.col("content_type_header"))).alias("html")))
    links = extract_links(struct).select("municipality", "edition_id", "article_id", "identifier", "title", "protocol",
                                         F.size("hierarchy_path").alias("depth"), "hierarchy_path", "seq", "pos")

    content = landed.where(F.col("phase") == "content").select("municipality", "request_key", "content_type_header", "body", "seq")
    split = C.split_inline(C.dispatch(content))
    return editions, links, split, _rejects(meta_rejects, links, split)


def _rejects(metadata: DataFrame, links: DataFrame, split: DataFrame) -> DataFrame:
    """What the three phases of a batch could not use."""
    no_id = links.where(F.col("identifier").isNull()).select(
        "municipality", F.lit("structure").alias("phase"), F.col("article_id").alias("request_key"), F.lit("missing_identifier").alias("reason"))
    bad_content = keep_where(split, F.col("reason").isNotNull()).select(
        "municipality", F.lit("content").alias("phase"), "request_key", "reason")
    return metadata.select("municipality", F.lit("metadata").alias("phase"), "request_key", "reason").unionByName(
        no_id).unionByName(bad_content)


def process_landed(spark: SparkSession, landed: DataFrame):
    """The batch form: parse and assemble one frame of landed responses: (corpus, split)."""
    editions, links, split, _ = parse_landed(spark, landed)
    return _assemble(spark, editions, links, split), split


def _assemble(spark: SparkSession, editions: DataFrame, links: DataFrame, split: DataFrame):
    """Of an edition listed more than once the last wins (J2), of content landed more than
    once for a portal's key likewise."""
    editions = A.latest_editions(editions, order=("seq", "item_index")).select(*_columns("editions")[:-2])
    split = A.latest_editions(split.select(*_columns("content")).where("reason is null"), key=PHASE_KEYS["content"],
                              order=("seq", "content_hash", "inline_text"))
    return assemble_corpus(spark, editions, links, split, order=("seq", "pos", "article_id"))


def _stage(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` written below ``_staging`` and read back: computed once, and no task of a later
    step goes further back than these files."""
    path = f"{root}/_staging/{name}"
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staged:
    """One micro-batch, parsed once: ``editions, links, split`` (with the bytes of bodies that
    go out of line) and ``rejects``."""

    def __init__(self, spark: SparkSession, landed: DataFrame, root: str):
        editions, links, split, rejects = parse_landed(spark, landed)
        self.editions = _stage(editions.select(*_columns("editions")), root, "editions")
        self.links = _stage(links.select(*_columns("links")), root, "links")
        self.split = _stage(split.select(*_columns("content"), F.when(F.col("is_blob"), F.col("bytes_")).alias("bytes_")), root, "content")
        meta_rejects = rejects.where("phase = 'metadata'")  # a branch of the union: the others are not run
        self.rejects = _rejects(_stage(meta_rejects, root, "meta_rejects"), self.links, self.split)


def _bucket(*key: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(BUCKETS)).cast("int")


def _store(df: DataFrame, root: str, phase: str, batch_id: str) -> None:
    (df.select(*_columns(phase), _bucket(*PHASE_KEYS[phase]).alias("bucket")).withColumn("batch_id", F.lit(batch_id))
     .hint("rebalance", F.col("bucket")).write.option("compression", "zstd")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").mode("overwrite").parquet(f"{root}/_phases/{phase}"))


def store_phases(staged: Staged, root: str, batch_id: str) -> None:
    links = staged.links.where("identifier is not null")
    _store(staged.editions, root, "editions", batch_id)
    _store(links, root, "links", batch_id)
    _store(links.select(*_columns("edition_links")).distinct(), root, "edition_links", batch_id)
    _store(staged.split, root, "content", batch_id)


def read_phase(spark: SparkSession, root: str, phase: str, keys: DataFrame | None = None) -> DataFrame:
    """Everything stored of a phase; with ``keys`` (the phase's key columns, in order) the rows
    of these keys, read from their buckets alone: no other bucket is listed or opened."""
    path = f"{root}/_phases/{phase}"
    schema = PHASE_SCHEMAS[phase] + ", bucket int, batch_id string"
    if keys is None:
        if not path_exists(spark, path):
            return spark.createDataFrame([], PHASE_SCHEMAS[phase])
        return spark.read.schema(schema).parquet(path).drop("bucket", "batch_id")
    names = list(PHASE_KEYS[phase])
    keys = keys.toDF(*names)
    have = set(subfolders(spark, path))
    wanted = [f"bucket={r[0]}" for r in keys.select(_bucket(*names)).distinct().collect()]  # BUCKETS rows at most
    paths = [f"{path}/{b}" for b in sorted(wanted) if b in have]
    if not paths:
        return spark.createDataFrame([], PHASE_SCHEMAS[phase])
    return (spark.read.schema(schema).option("basePath", path).parquet(*paths).join(keys, names, "left_semi")
            .select(*_columns(phase)))


def touched_editions(spark: SparkSession, root: str, staged: Staged) -> DataFrame:
    """Keys of the editions whose rows a batch can change."""
    brought = (staged.links.select("municipality", "identifier")
               .unionByName(staged.split.select("municipality", F.col("request_key").alias("identifier")))
               .where("identifier is not null").distinct())
    return (staged.editions.select(*A.EDITION_KEY).unionByName(staged.links.select(*A.EDITION_KEY))
            .unionByName(read_phase(spark, root, "links", brought).select(*A.EDITION_KEY)).distinct())


def touched_corpus(spark: SparkSession, root: str, staged: Staged):
    """The touched editions, assembled from all that is stored of them. An identifier's deepest
    link is chosen among all its links, also those in other editions; then only the links of
    touched editions go on."""
    keys = _stage(touched_editions(spark, root, staged), root, "touched")
    ids = _stage(read_phase(spark, root, "edition_links", keys).select("municipality", "identifier").distinct(), root, "identifiers")
    best = A.dedupe_keep_deepest(read_phase(spark, root, "links", ids), order=("seq", "pos", "article_id"))
    return _assemble(spark, read_phase(spark, root, "editions", keys), best.join(keys, list(A.EDITION_KEY), "left_semi"),
                     read_phase(spark, root, "content", ids))


def current_rejects(spark: SparkSession, root: str) -> DataFrame:
    """P17 + J3: stored rejects of all batches, and links that cannot be used as things
    stand: their edition is unknown, or no valid content has landed for them on their portal."""
    links = read_phase(spark, root, "links")
    editions = read_phase(spark, root, "editions").select(*A.EDITION_KEY)
    valid = read_phase(spark, root, "content").where("reason is null").select("municipality", F.col("request_key").alias("identifier"))
    row = lambda df, reason: df.select("municipality", F.lit("structure").alias("phase"),
                                       F.col("article_id").alias("request_key"), F.lit(reason).alias("reason"))
    return (lake.read_table(spark, root, "rejects").select("municipality", "phase", "request_key", "reason")
            .unionByName(row(A.orphan_articles(links, editions), "orphan"))
            .unionByName(row(links.join(valid, ["municipality", "identifier"], "left_anti"), "missing_content")))


def ingest_batch(spark: SparkSession, landed: DataFrame, root: str, batch_id: str, granularity: str = "day") -> dict:
    """One micro-batch: parse it, store its phases, then rewrite the editions it touches."""
    staged = Staged(spark, landed, root)
    store_phases(staged, root, batch_id)
    n_rejects = lake.write_rejects(staged.rejects, root, batch_id)
    return lake.write_corpus(spark, touched_corpus(spark, root, staged), root, batch_id, granularity,
                             content_bodies=staged.split, also={"rejects": n_rejects})


class ProgressLog(StreamingQueryListener):
    """Input rows and durations of the micro-batches, as Spark reports them (R2). It watches a
    run; the totals that survive a restart come from the committed batches (`lake.run_totals`)."""

    def __init__(self):
        self.batches: list[dict] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"epoch": p.batchId, "rows": p.numInputRows, "ms": dict(p.durationMs).get("triggerExecution")})

    def onQueryTerminated(self, event) -> None:
        self.ended = True

    def wait(self, seconds: float = 10.0) -> None:
        """Events come on a bus of their own, after the query itself."""
        until = time.monotonic() + seconds
        while not self.ended and time.monotonic() < until:
            time.sleep(0.05)


def run_incremental(spark: SparkSession, landing_dir: str, lake_root: str, checkpoint_dir: str,
                    run_id: str, max_files_per_trigger: int = 1, granularity: str = "day",
                    progress: ProgressLog | None = None) -> list[dict]:
    """R1 + R2: drain the landing folder batch by batch into the lake; returns the counts of
    the batches that this call wrote. The totals of the whole run, earlier calls included, are
    ``lake.run_totals(spark, lake_root, run_id)``: they are read from the committed batches, so
    a restart neither loses nor repeats any."""
    done: list[dict] = []

    def handle(batch: DataFrame, epoch_id: int) -> None:
        s = ingest_batch(batch.sparkSession, batch, lake_root, f"{run_id}_{epoch_id:06d}", granularity)
        done.append(s | {"epoch": epoch_id})

    if progress is not None:
        spark.streams.addListener(progress)
    try:
        q = (stream_landed(spark, landing_dir, max_files_per_trigger)
                  .writeStream.foreachBatch(handle)
                  .option("checkpointLocation", checkpoint_dir)
                  .trigger(availableNow=True).start())
        q.awaitTermination()
        if progress is not None:
            progress.wait()
    finally:
        if progress is not None:
            spark.streams.removeListener(progress)
    return done
