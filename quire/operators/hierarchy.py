"""Hierarchy-path operators.

Paths stay native ``array<string>`` columns. Every frequency is aggregated first (with
map-side partial aggregation, so a path or element that dominates the corpus collapses
to one row per task before the shuffle); ranking, shares and pivots then work on the
aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import path_label


def explode_levels(df: DataFrame, path: str = "hierarchy_path", id_col: str = "article_id") -> DataFrame:
    """One row per (id, level 0-based, element, depth). Empty paths give no rows."""
    return df.select(id_col, F.posexplode(path).alias("level", "element"),
                     F.size(path).alias("depth"))


def wide_levels(df: DataFrame, n_levels: int, path: str = "hierarchy_path",
                keep: tuple[str, ...] = ("article_id",)) -> DataFrame:
    """P23 + F8: level_1..level_n columns (1-based, NULL past the end); rows whose path
    is NULL (unparsable) are dropped."""
    return (df.where(F.col(path).isNotNull())
              .select(*keep, *[F.try_element_at(path, F.lit(i)).alias(f"level_{i}")
                               for i in range(1, n_levels + 1)]))


def max_depth(df: DataFrame, path: str = "hierarchy_path") -> int:
    """Deepest path in the data (one scalar aggregate); sizes the wide layout."""
    v = df.agg(F.max(F.size(path))).first()[0]
    return int(v or 0)


def path_frequency(df: DataFrame, path: str = "hierarchy_path") -> DataFrame:
    """(path label, count)."""
    return df.groupBy(path_label(path).alias("path")).agg(F.count(F.lit(1)).alias("count"))


def level_frequency(levels: DataFrame) -> DataFrame:
    """(level, element, count)."""
    return levels.groupBy("level", "element").agg(F.count(F.lit(1)).alias("count"))


def with_level_share(freq: DataFrame) -> DataFrame:
    """Count / level total. Level totals are one row per level; the join is left to
    AQE, which broadcasts them after measuring their (tiny) size."""
    totals = freq.groupBy("level").agg(F.sum("count").alias("level_total"))
    return (freq.join(totals, "level")
                .withColumn("pct", F.col("count") * 100.0 / F.col("level_total")))


def top_per_level(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent elements of each level (tie: element). Spark plans a
    partial rank limit before the shuffle, so each task ships at most n rows per level."""
    w = Window.partitionBy("level").orderBy(F.desc("count"), "element")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pareto(freq: DataFrame, level: int, n: int) -> DataFrame:
    """T4 + W2 + W3: top-n elements of one level with share of the level total and the
    running (cumulative) share over those n rows."""
    lv = freq.where(F.col("level") == level)
    total = lv.agg(F.sum("count")).scalar()
    top = lv.orderBy(F.desc("count"), "element").limit(n)
    w = Window.orderBy(F.desc("count"), "element").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # running share from the running count: exact integer sum, then one division
    return (top.withColumn("pct", F.col("count") * 100.0 / total)
               .withColumn("cum_pct", F.sum("count").over(w) * 100.0 / total)
               .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "element"))))


def top_elements(freq: DataFrame, level: int, n: int) -> DataFrame:
    """T4: the n most frequent elements of one level (a top-k: at most n rows)."""
    return (freq.where(F.col("level") == level).orderBy(F.desc("count"), "element").limit(n)
                .select("element", "count"))


def level_pairs(paths: DataFrame, path: str = "hierarchy_path") -> DataFrame:
    """(level_0, level_1) per path of depth >= 2. A path has exactly one element per
    level, so this needs no self-join of exploded levels."""
    p = F.col(path)
    # try_element_at: NULL-safe even if the projection is evaluated ahead of the filter
    return paths.where(F.size(p) >= 2).select(F.try_element_at(p, F.lit(1)).alias("level_0"),
                                              F.try_element_at(p, F.lit(2)).alias("level_1"))


def pair_counts(pairs: DataFrame, level1_keep: DataFrame | None = None) -> DataFrame:
    """A15 (+ J9/F7): counts of (level_0, level_1), optionally semi-joined to a top-N list
    of level-1 elements (Spark sizes the join)."""
    if level1_keep is not None:
        pairs = pairs.join(level1_keep.select(F.col("element").alias("level_1")), "level_1", "left_semi")
    return pairs.groupBy("level_0", "level_1").agg(F.count(F.lit(1)).alias("count"))


def filled_pairs(counts: DataFrame, level1_keep: DataFrame) -> DataFrame:
    """A16 in long form: every level_0 element with every one of the top-N level_1 elements,
    absent pairs as 0. The N elements travel as one array and are exploded per row; nothing
    is cross-joined or collected."""
    names = level1_keep.agg(F.collect_set("element")).scalar()  # N elements
    grid = counts.select("level_0").distinct().select("level_0", F.explode(names).alias("level_1"))
    return (grid.join(counts, ["level_0", "level_1"], "left")
                .select("level_0", "level_1", F.coalesce("count", F.lit(0)).alias("count")))


def pair_shares(filled: DataFrame) -> DataFrame:
    """A18 in long form: each count divided by the sum of its level_1 element (NULL if 0)."""
    totals = filled.groupBy("level_1").agg(F.sum("count").alias("_t"))
    return filled.join(totals, "level_1").select(
        "level_1", "level_0", F.try_divide(F.col("count").cast("double"), F.col("_t")).alias("share"))


def pivot_counts(counts: DataFrame, row: str, col: str, values: list, max_columns: int = 1000) -> DataFrame:
    """A16/A17 in wide form, on request: one column per value (fixed order), absent cells as
    0. More than ``max_columns`` values are refused: use the long form."""
    if len(values) > max_columns:
        raise ValueError(f"{len(values)} columns; the limit is {max_columns}")
    return (counts.groupBy(row).pivot(col, values).agg(F.sum("count"))
                  .na.fill(0, subset=[str(v) for v in values]))


def row_normalise(matrix: DataFrame, row: str, value_cols: list[str]) -> DataFrame:
    """Each cell divided by its row sum (NULL when the row sums to 0)."""
    total: Column = sum((F.col(f"`{c}`") for c in value_cols), F.lit(0))
    return matrix.select(row, *[F.try_divide(F.col(f"`{c}`").cast("double"), total).alias(c)
                                for c in value_cols])
