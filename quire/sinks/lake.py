"""Lake writers and maintenance.

Layout under ``root``::

    editions/      municipality=/year=/month=[/day=]/batch_id=/part-*.parquet
    articles/      same partitioning
    relationships/ same partitioning
    content/       prefix=<first two hash chars>/part-*.parquet   (blobs, one row per hash)
    rejects/       batch_id=/part-*.parquet                       (phase, key, reason)
    commits/       batch_id=/part-*.parquet                       (one row: the counts of a batch)

An edition that is written again (a re-crawl, a late page) gets a full new set of rows in its
new batch. A batch's marker in ``commits`` is written after all its tables. `read_current`
gives the rows of each edition's latest committed batch, so the rows of a batch appear all at
once, and those of a batch that failed half-way never; every report and query reads a lake
through it. Run totals are sums over the markers.

* K6 is honoured: the partition granularity is day, month or year.
* Re-running a batch is idempotent: tables are written with dynamic partition
  overwrite and ``batch_id`` is the innermost partition column, so a rerun replaces
  exactly its own files.
* Content is content-addressed: a hash already stored is never written again. The
  existence test reads the hash column of those prefixes alone that the batch's own hashes have.
* Articles are clustered by date and identifier inside their files, with a Parquet bloom
  filter on the identifier: a query for one identifier skips the row groups without it.
* Files are zstd-compressed (level 9 by default), with dictionary and statistics.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions.rows import keep_where
from quire.operators.content import new_blobs
from quire.sources.files import path_exists

TABLES = ("editions", "articles", "relationships", "content")
GRANULARITY = {"year": ["year"], "month": ["year", "month"], "day": ["year", "month", "day"]}
ZSTD_LEVEL = 9


def new_batch_id(now: dt.datetime | None = None, suffix: str | None = None) -> str:
    """``batch_<yyyyMMdd_HHmmss>`` plus an optional unique suffix (micro-batch id),
    so two batches in the same second never collide."""
    now = now or dt.datetime.now()
    b = f"batch_{now:%Y%m%d_%H%M%S}"
    return f"{b}_{suffix}" if suffix is not None else b


def partition_columns(granularity: str = "day") -> list[str]:
    if granularity not in GRANULARITY:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITY)}")
    return ["municipality", *GRANULARITY[granularity], "batch_id"]


# Files of a hot partition value are split by rows; which tasks write it is left to AQE.
MAX_RECORDS_PER_FILE = 5_000_000


# Order of the rows inside a file, and the columns with a bloom filter.
CLUSTER = {"articles": ("publication_date", "identifier")}
BLOOM = {"articles": ("identifier",)}


def _writer(df: DataFrame, parts: list[str], obs: Observation | None = None, zstd_level: int = ZSTD_LEVEL, table: str = ""):
    """K5: zstd, dictionary encoding and column statistics (parquet defaults kept on); for a
    table in ``CLUSTER`` its row order, for one in ``BLOOM`` its filters, sized by what they hold.

    A REBALANCE hint on the partition columns brings a partition value's rows together, and
    AQE splits a value by its measured size when it exceeds the advisory partition size: a hot
    municipality-day is written by as many tasks as it needs. A frame with a
    ``_finish`` has its rows completed by it behind that exchange."""
    out = df.hint("rebalance", *[F.col(k) for k in parts])
    if getattr(df, "_finish", None) is not None:
        out = df._finish(out)
    if table in CLUSTER:
        out = out.sortWithinPartitions(*parts, *CLUSTER[table])
    if obs is not None:
        out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = (out.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(zstd_level))
            .option("parquet.enable.dictionary", "true").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .option("partitionOverwriteMode", "dynamic").partitionBy(*parts))
    for column in BLOOM.get(table, ()):
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    return w


def stamp(df: DataFrame, batch_id: str) -> DataFrame:
    """Run columns: batch id and processing time (timestamp without zone)."""
    return df.withColumn("batch_id", F.lit(batch_id)).withColumn("processed_at", F.localtimestamp())


def write_corpus(spark: SparkSession, corpus, root: str, batch_id: str, granularity: str = "day",
                 content_bodies: DataFrame | None = None, also: dict | None = None) -> dict:
    """K1-K4: persist one batch and commit it; returns row counts gathered while writing.

    ``content_bodies`` is the dispatched/split content frame with a ``bytes_`` column
    (see quire.operators.content); when given, new blobs are appended to ``content``. ``also``
    holds more counts for the commit marker.
    """
    import time
    started = time.perf_counter()
    if hasattr(corpus, "materialize"):
        corpus.materialize(f"{root}/_checkpoint")  # what the three tables share is stored once
    parts = partition_columns(granularity)
    stats = {"batch_id": batch_id, **(also or {})}
    try:
        if content_bodies is not None:
            stats["content"] = append_content(spark, content_bodies, root, batch_id)
        for name in ("articles", "relationships", "editions"):
            rows, finish = getattr(corpus, name, None), None
            if not hasattr(corpus, "rows"):
                rows, finish = getattr(corpus, name), None
            else:
                rows, finish = corpus.rows(name), lambda df, name=name: corpus.finished(df, name, "batch_id", "processed_at")
            obs = Observation(f"{name}_{batch_id}")
            stamped = stamp(rows, batch_id)
            stamped._finish = finish
            _writer(stamped, parts, obs, table=name).mode("overwrite").parquet(f"{root}/{name}")
            stats[name] = obs.get["rows"]
    finally:
        if hasattr(corpus, "release"):
            corpus.release()
    stats["seconds"] = round(time.perf_counter() - started, 3)
    commit(spark, root, stats)
    return stats


COUNTS = ("editions", "articles", "relationships", "content", "rejects")


def commit(spark: SparkSession, root: str, stats: dict) -> None:
    """Mark a batch as complete: one row with its counts, one file. A replay replaces it."""
    row = [tuple(int(stats.get(k) or 0) for k in COUNTS) + (float(stats.get("seconds") or 0.0), stats["batch_id"])]
    (spark.createDataFrame(row, ", ".join(f"{k} bigint" for k in COUNTS) + ", seconds double, batch_id string").coalesce(1)
     .withColumn("committed_at", F.localtimestamp()).write.option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").mode("overwrite").parquet(f"{root}/commits"))


def run_summary(batch_stats: list[dict]) -> dict:
    """K10 + R2: totals over the batches of a run, with editions/s and articles/s over
    the time spent writing."""
    total = {k: sum(int(b.get(k) or 0) for b in batch_stats) for k in COUNTS}
    secs = sum(float(b.get("seconds") or 0.0) for b in batch_stats)
    total.update(batches=len(batch_stats), seconds=round(secs, 3),
                 editions_per_s=round(total["editions"] / secs, 2) if secs else None,
                 articles_per_s=round(total["articles"] / secs, 2) if secs else None)
    return total


def run_totals(spark: SparkSession, root: str, run_id: str | None = None) -> dict:
    """R2: `run_summary` of the committed batches of a run (``<run_id>_<epoch>``), or of all:
    the same whether the run went through at once or was killed and started again."""
    c = read_table(spark, root, "commits")
    if run_id is not None:
        c = c.where(F.col("batch_id").startswith(f"{run_id}_"))
    r = c.agg(F.count(F.lit(1)).alias("batches"), *[F.sum(k).alias(k) for k in (*COUNTS, "seconds")]).first().asDict()
    return run_summary([r]) | {"batches": r["batches"]}


def append_content(spark: SparkSession, split: DataFrame, root: str, batch_id: str | None = None) -> int:
    """K4 + J11 + R4: append blobs whose hash is not stored yet; returns the rows that the batch
    has added, those of an earlier try of the same batch included. Of the store only the
    prefixes of the batch's own hashes are read (a filter on the partition column). A store
    that cannot be read is an error; only a store that is not there yet is empty."""
    path = f"{root}/content"
    existing, before = None, 0
    if path_exists(spark, path):
        prefixes = [r[0] for r in keep_where(split, F.col("is_blob")).select(F.substring("content_hash", 1, 2)).distinct().collect()]  # 256 at most
        existing = stored_hashes(spark, root, prefixes)
        if batch_id is not None:
            before = existing.where(F.col("batch_id") == batch_id).count()
    obs = Observation("blobs")
    blobs = new_blobs(split, existing).withColumns({"batch_id": F.lit(batch_id).cast("string"), "prefix": F.substring("content_hash", 1, 2)})
    _writer(blobs, ["prefix"], obs).mode("append").parquet(path)
    return before + obs.get["rows"]


def stored_hashes(spark: SparkSession, root: str, prefixes: list[str]) -> DataFrame:
    """Hashes of the content store below the given prefixes; the filter prunes directories."""
    return (spark.read.schema("content_hash string, batch_id string, prefix string").parquet(f"{root}/content")
            .where(F.col("prefix").isin(prefixes)).select("content_hash", "batch_id"))


def read_content(spark: SparkSession, root: str, refs: DataFrame) -> DataFrame:
    """The stored bodies of ``refs`` (a frame with ``content_hash``, such as articles): its
    rows with ``content``, null where there is no hash or no body. Only the prefixes that occur
    are read."""
    prefixes = [r[0] for r in refs.where("content_hash is not null").select(F.substring("content_hash", 1, 2)).distinct().collect()]  # 256 at most
    bodies = read_table(spark, root, "content").where(F.col("prefix").isin(prefixes)).select("content_hash", "content")
    return refs.join(bodies, "content_hash", "left")


def write_rejects(rejects: DataFrame, root: str, batch_id: str) -> int:
    """What one batch could not use: municipality, phase, request_key, reason."""
    obs = Observation(f"rejects_{batch_id}")
    (rejects.select("municipality", "phase", F.col("request_key").cast("string").alias("request_key"), "reason")
     .withColumn("batch_id", F.lit(batch_id)).observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
     .mode("overwrite").parquet(f"{root}/rejects"))
    return obs.get["rows"]


_PARTS = "municipality string, year int, month int, day int, batch_id string"
SCHEMAS = {
    "editions": "edition_id string, publication_date date, edition_number int, supplement boolean, edition_type_id int, "
                "edition_type_name string, pdf_url string, total_articles int, edition_hash string, "
                "processed_at timestamp_ntz, " + _PARTS,
    "articles": "article_id string, edition_id string, edition_hash string, publication_date date, title string, "
                "hierarchy_path array<string>, hierarchy_path_json string, identifier string, protocol string, depth int, "
                "content_type string, content_size bigint, content_hash string, content_path string, inline_text string, "
                "processed_at timestamp_ntz, " + _PARTS,
    "relationships": "edition_id string, article_id string, edition_hash string, publication_date date, "
                     "processed_at timestamp_ntz, " + _PARTS,
    "content": "content_hash string, content binary, content_path string, content_size bigint, created_at timestamp, "
               "batch_id string, prefix string",
    "commits": ", ".join(f"{k} bigint" for k in COUNTS) + ", seconds double, committed_at timestamp_ntz, batch_id string",
    "rejects": "phase string, request_key string, reason string, municipality string, batch_id string",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a lake table under its fixed schema (pruned by partition filters); a table that
    was never written is empty."""
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).option("basePath", path).parquet(path)


def _latest(spark: SparkSession, root: str) -> DataFrame:
    committed = read_table(spark, root, "commits").select("batch_id")
    return (read_table(spark, root, "editions").join(committed, "batch_id", "left_semi").groupBy("municipality", "edition_id")
            .agg(F.max_by("batch_id", F.struct("processed_at", "batch_id")).alias("batch_id")))


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows that hold now: of every edition those of its latest committed batch. The
    batches are found on three narrow columns of the editions table and the commit markers."""
    df = read_table(spark, root, name)
    if name not in ("editions", "articles", "relationships"):
        return df
    return df.join(_latest(spark, root), ["municipality", "edition_id", "batch_id"], "left_semi")


def dry_run(corpus) -> dict:
    """K9: run the plan without writing, as one job: the editions table into the ``noop`` sink,
    with an observation of the articles where their edition counts are joined, and one of the
    articles kept by the dedupe that have content. Every input is read once."""
    kept, out = Observation("kept"), Observation("editions")
    df = corpus.counted(kept).editions
    df.observe(out, F.count(F.lit(1)).alias("editions"), F.sum("total_articles").alias("articles")).write.format("noop").mode("overwrite").save()
    n = out.get["articles"] or 0  # an article is a row of an edition, and so is a relationship
    return {"editions": out.get["editions"], "articles": n, "relationships": n, "orphans": kept.get["rows"] - n}


def _table_stats(df: DataFrame) -> DataFrame:
    """(files, rows, bytes) of a file-based table from its ``_metadata`` column."""
    m = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    per_file = m.groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.first("s").alias("bytes"))
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def storage_stats(spark: SparkSession, root: str) -> DataFrame:
    """Files, rows and bytes per table, from the files' own metadata columns."""
    frames = []
    for name in TABLES:
        if not path_exists(spark, f"{root}/{name}"):
            continue
        df = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
        frames.append(_table_stats(df).withColumn("table", F.lit(name)))
    if not frames:
        return spark.createDataFrame([], "table string, files bigint, rows bigint, bytes bigint")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("table", "files", "rows", "bytes")


MANIFEST = "table string, file string, length bigint, modified timestamp, rows bigint, checksum decimal(38,0)"


def _tail(name: str):
    """The path of a row's file below its table."""
    return F.regexp_extract(F.col("_metadata.file_path"), f".*/{name}/(.*)$", 1)


def _data_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Data files of a table: ``file`` (its path below the table), ``length, modified``; listed, not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(f"{root}/{name}").select(_tail(name).alias("file"), "length", F.col("modificationTime").alias("modified")))


def _sums(df: DataFrame, *by: str) -> DataFrame:
    """Rows and checksum (a sum of row hashes: in any order) by file or by partition."""
    cols = sorted(c for c in df.columns if c != "file")
    return (df.select(*by, F.xxhash64(*cols).cast("decimal(38,0)").alias("_h"))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").alias("checksum")))


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Source files of a table that `migrate` has copied to ``root``."""
    path = f"{root}/_manifest"
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("basePath", path).parquet(path).where(F.col("table") == name)


def migrate(spark: SparkSession, src_root: str, dst_root: str, granularity: str = "day") -> list[dict]:
    """K8: copy every table to another root/URI (e.g. an s3a:// bucket), keeping the
    partitioning; reports rows, files and bytes of each table there; a failing table is
    reported and the others continue.

    The manifest below ``dst_root`` holds every source file copied, with its length, time, rows
    and checksum. Files are listed, and those in the manifest are left alone; a partition that
    any other file has rows of is copied whole (its folder is replaced), its rows and checksum
    are compared, and only then are the files entered. So a second run writes nothing, and an interrupted one
    is completed. Commit markers come last: nothing shows at the target before it is there.
    """
    report = []
    for name in (*TABLES, "rejects", "commits"):
        optional = name in ("rejects", "commits")
        try:
            if not path_exists(spark, f"{src_root}/{name}"):
                if optional:
                    continue
                raise FileNotFoundError(f"{src_root}/{name}")
            report.append({"table": name, **_migrate_table(spark, src_root, dst_root, name, granularity), "ok": True})
        except Exception as exc:  # continue with the next dataset
            report.append({"table": name, "rows": 0, "copied": 0, "ok": False, "error": str(exc)[:200]})
    return report


def _migrate_table(spark: SparkSession, src_root: str, dst_root: str, name: str, granularity: str) -> dict:
    parts = {"content": ["prefix"], "rejects": ["batch_id"], "commits": ["batch_id"]}.get(name) or partition_columns(granularity)
    new = _data_files(spark, src_root, name).join(manifest(spark, dst_root, name), ["file", "length", "modified"], "left_anti")
    copied = 0
    if new.limit(1).count():
        rows = read_table(spark, src_root, name).withColumn("file", _tail(name))  # fixed schema: prefix 07 stays text
        of_new = rows.join(new.select("file"), "file", "left_semi")
        todo = rows.join(of_new.select(*parts).distinct(), parts, "left_semi").drop("file")
        obs = Observation(f"migrate_{name}")
        _writer(todo, parts, obs, table=name).mode("overwrite").parquet(f"{dst_root}/{name}")
        copied = obs.get["rows"]
        bad = _sums(todo, *parts).join(_sums(read_table(spark, dst_root, name), *parts), [*parts, "rows", "checksum"], "left_anti")
        if bad.limit(1).count():
            raise RuntimeError(f"{name}: copied rows differ from the source")
        entries = new.join(_sums(of_new, "file"), "file").select(F.lit(name).alias("table"), "file", "length", "modified", "rows", "checksum")
        entries.write.partitionBy("table").mode("append").parquet(f"{dst_root}/_manifest")
    if not path_exists(spark, f"{dst_root}/{name}"):  # a table without rows
        return {"rows": 0, "files": 0, "bytes": 0, "copied": 0}
    written = _table_stats(spark.read.schema(SCHEMAS[name]).parquet(f"{dst_root}/{name}")).first()
    return {"rows": written["rows"], "files": written["files"], "bytes": written["bytes"], "copied": copied}
