"""Landed raw responses (the re-aimed HTTP fetch).

An external fetcher lands every response it gets (bytes + headers) as rows of
``RAW_SCHEMA``; failed fetches land in a fetch log instead. Spark never talks to the
portals: it reads what was landed, aligns responses to requests by key (not by list
position) and parses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = ("municipality string, phase string, request_key string, edition_id string, "
              "content_type_header string, body binary, seq bigint")
PHASES = ("metadata", "structure", "content")


def read_landed(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """Batch read of a landing folder (all files below it); optional phase filter, which
    is pushed into the parquet scan."""
    df = spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    if phase is not None:
        if phase not in PHASES:
            raise ValueError(f"phase must be one of {PHASES}")
        df = df.where(F.col("phase") == phase)
    return df


def stream_landed(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming read of the same folder: each trigger takes at most
    ``max_files_per_trigger`` new files (one crawl batch per file)."""
    return (spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                 .option("recursiveFileLookup", "true").parquet(path))
