"""Corpus pipeline: quality rules, near-dedup, PII, source mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return
the columns of ``documents``; the last returns the packed pieces. `run` writes each stage's
result as Parquet in the shared folder and hands the written table to the next stage, so a
lost executor costs a re-read and no stage runs twice.

Rows with nulls, empty texts, repeated rows, extra columns and empty tables are defined by
the operators' docstrings (``quire.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, pii, quality_rules, simhash
from quire.llm.common import materialize, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first rules: failing lines go, documents that lose too much or fail the base go."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span is masked by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it (0, 1 or 2 times)."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 words with their texts, and their bins; ``row`` tells the copies
    of a document apart."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

# The mix draws at random and near-dedup hashes with XXH64: no SQL twin. tests/llm holds
# every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last stage's rows. What a stage wrote on its way
    is deleted when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
    return docs


def write_bins(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Run all stages and write the packed sequences, one row per bin, as Parquet in ``path``."""
    packing.bins(run(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)
