"""Parquet and file scans.

These are thin on purpose: Spark's readers already do projection and filter pushdown,
recursive listing, corrupt-file skipping and per-file lineage (``_metadata``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system; any other failure raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates with all it holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none where it does not exist. For a level
    of bounded fan-out (buckets, prefixes): one listing, whatever lies below."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None, schema=None) -> DataFrame:
    """One path, a directory, or an explicit list of files; optional projection
    (the scan's ReadSchema then holds only those columns)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.parquet(*paths)
    return df.select(*columns) if columns else df


def read_parquets(spark: SparkSession, base_dir: str, merge_schema: bool = True) -> DataFrame:
    """Every parquet file under ``base_dir`` (recursively), unioned, with a
    ``__source_file__`` lineage column; unreadable files are skipped."""
    return (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
                 .option("mergeSchema", str(merge_schema).lower()).option("pathGlobFilter", "*.parquet")
                 .parquet(base_dir)
                 .withColumn("__source_file__", F.col("_metadata.file_path")))


def list_files(spark: SparkSession, prefix: str, suffix: str | None = None) -> DataFrame:
    """S10 + T7: (path, length, modified) of the files under ``prefix``, sorted by path.
    The binary content column is never read (pruned). A missing prefix gives no rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    if not path_exists(spark, prefix):
        return spark.createDataFrame([], "path string, length bigint, modified timestamp")
    df = reader.load(prefix)
    return df.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")
