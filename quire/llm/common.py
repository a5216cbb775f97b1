"""Shared helpers: reading the tables, written intermediates, distributed order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import ensure_checkpoint_dir, ship_package

# Words are runs of anything but space and the controls 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
ARROW_ROWS = 1000  # rows in an Arrow batch: long texts stay small in a Python worker


def prepare(spark: SparkSession) -> None:
    """Settings that the Python operators need: small Arrow batches, importable code."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if not urlparse(base).scheme and not base.startswith("/"):
        raise ValueError(f"spark.checkpoint.dir must be absolute: {base}")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and no
    stage runs twice (an eager ``checkpoint()`` runs its last stage once to compute and
    once more to write). The read path has a known size, so small tables are broadcast
    by Spark's own size check and larger ones are shuffled.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    for made in _SCOPES:
        made.append(path)
    return out


_SCOPES: list[list[str]] = []  # of the `scratch` blocks that are open


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete a table made by `materialize` that no later frame reads."""
    path = getattr(df, "_quire_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At the end of the block the tables that `materialize` wrote in it are deleted, but those
    in the list that it yields: put there what is still to be read. A block that fails keeps
    everything."""
    made: list[str] = []
    kept: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield kept
        left = {getattr(df, "_quire_path", None) for df in kept}
        for path in made:
            if path not in left:
                _delete(spark, path)
    finally:
        _SCOPES.remove(made)


def pack_row(df: DataFrame) -> DataFrame:
    """All columns as one struct ``_row``: helper columns beside it cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpack_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def code_bucket(id_col: Column, buckets: int) -> Column:
    """crc32 of the id written as text, modulo ``buckets`` (null id: the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % buckets


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and use it many times inside ``body``.

    Expressions inside a lambda of a higher-order function are evaluated again for every
    element; a lambda variable is not.
    """
    return F.transform(F.array(expr), lambda v: body(v))[0]


def words_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+"))


def ordered_index(df: DataFrame, order: list[Column], index: str = "_index") -> DataFrame:
    """Add the 0-based position of every row in a total order, without one big task.

    Rows are range partitioned and sorted, numbered inside their partition, and shifted by
    the number of rows in the partitions before (one small row per partition).
    The result is written in the shared folder: its order must not be computed twice.
    """
    mono = F.monotonically_increasing_id()
    srt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = materialize(srt.withColumn("_m", mono)
                       .withColumn("_pid", F.shiftright("_m", 33))
                       .withColumn("_pos", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "order")
    sizes = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start")), "starts")
    # one row per partition of the sort: bounded by spark.sql.shuffle.partitions
    return (part.join(F.broadcast(starts), "_pid")
            .withColumn(index, F.col("_start") + F.col("_pos")).drop("_start", "_pos", "_pid"))


HOT_KEYS = 1000  # a key with more than one in so many rows is joined from a broadcast table


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """Inner join of ``rows`` (``n`` of them) to ``groups``: one row a key, with the number of
    ``rows`` that have it in ``count``.

    Keys with more than ``n / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, whatever the data:
    their groups are broadcast, so a key with a third of all rows is joined where its rows
    lie. The others are joined by Spark's choice, and none fills a task.
    """
    limit = -(-n // HOT_KEYS)
    hot = materialize(groups.where(F.col(count) > limit), "hot-groups")
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(count) <= limit), key))
