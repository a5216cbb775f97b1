"""Hierarchy reports over the article paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import clip, ellipsize
from quire.operators import hierarchy as H
from quire.sources import driver

TOP_PATHS = 20
TOP_PER_LEVEL = 10
LEVELS_REPORTED = 5
PARETO_N = 12
PIVOT_TOP_LEVEL1 = 10


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return driver.article_paths(spark, d)


def path_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A13 + T3 + W2 + P21: the 20 most common paths with share of all articles."""
    p = _paths(spark, d)
    total = p.agg(F.count(F.lit(1))).scalar()
    freq = H.path_frequency(p)
    top = freq.orderBy(F.desc("count"), "path").limit(TOP_PATHS)
    w = Window.orderBy(F.desc("count"), "path")
    return top.select(F.row_number().over(w).alias("rank"), "path",
                      ellipsize("path", 80, 77).alias("display_path"), "count",
                      (F.col("count") * 100.0 / total).alias("pct"))


def path_count(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct paths and of articles."""
    p = _paths(spark, d)
    return H.path_frequency(p).agg(F.count(F.lit(1)).alias("n_distinct_paths"),
                                   F.sum("count").alias("n_articles"))


def hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    """P22 + A14 + W2: element frequency per level with share within the level."""
    lv = H.explode_levels(_paths(spark, d))
    return H.with_level_share(H.level_frequency(lv)).select("level", "element", "count", "pct")


def wide_levels(spark: SparkSession, d: str) -> DataFrame:
    """level_1..level_max, max depth discovered from the data."""
    p = _paths(spark, d)
    return H.wide_levels(p, H.max_depth(p))


def top_per_level(spark: SparkSession, d: str) -> DataFrame:
    """Top-10 elements of levels 0..4 with their share of the level."""
    lv = H.explode_levels(_paths(spark, d)).where(F.col("level") < LEVELS_REPORTED)
    freq = H.with_level_share(H.level_frequency(lv))
    return (H.top_per_level(freq, TOP_PER_LEVEL)
             .select("level", "rank", clip("element", 60).alias("element"), "count", "pct"))


def level_pareto(spark: SparkSession, d: str) -> DataFrame:
    """T4 + W2 + W3: top-12 of level 0 and of level 1, share and cumulative share."""
    freq = H.level_frequency(H.explode_levels(_paths(spark, d)).where(F.col("level") <= 1))
    parts = [H.pareto(freq, lvl, PARETO_N).withColumn("level", F.lit(lvl)) for lvl in (0, 1)]
    return parts[0].unionByName(parts[1]).select("level", "rank", "element", "count", "pct", "cum_pct")


def _top_level1(spark: SparkSession, d: str) -> DataFrame:
    freq = H.level_frequency(H.explode_levels(_paths(spark, d)).where(F.col("level") == 1))
    return H.top_elements(freq, 1, PIVOT_TOP_LEVEL1)


def level_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J8 + J9 + A15 + F7: (level_0, level_1) counts for the top-10 level-1 elements."""
    pairs = H.level_pairs(_paths(spark, d))
    return H.pair_counts(pairs, _top_level1(spark, d))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    top = _top_level1(spark, d)
    return H.filled_pairs(H.pair_counts(H.level_pairs(_paths(spark, d)), top), top)


def level_pivot(spark: SparkSession, d: str) -> DataFrame:
    """level_0 by top-10 level-1 element, zeros filled, in long form."""
    return _filled(spark, d)


def level_pivot_transposed(spark: SparkSession, d: str) -> DataFrame:
    """The matrix transposed, with the rank of every cell in its row (long form)."""
    w = Window.partitionBy("level_1").orderBy(F.desc("count"), "level_0")
    return _filled(spark, d).select("level_1", "level_0", "count", F.row_number().over(w).alias("rank"))


def level_pivot_share(spark: SparkSession, d: str) -> DataFrame:
    """The transposed matrix normalised by row (long form)."""
    return H.pair_shares(_filled(spark, d))
