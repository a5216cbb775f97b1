"""Row selection on expensively derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows of ``df`` where ``cond`` holds, with ``cond`` evaluated on the projected row.

    A plain ``where`` on a derived column (a parse outcome, a reject reason) is pushed by
    Catalyst below the projection that derives it, so the predicate re-derives the value
    (decode, JSON parse, hash) and the projection derives it again. Expressing the
    selection as an explode of a zero-or-one element array keeps it above the
    projection: every value is derived once per row. Same rows, same order."""
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("__keep")).drop("__keep")


def deal_out(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """Rows dealt over all cores before an expensive row-local stage, where the input is too
    small to fill them by itself.

    A scan makes about one task for each ``spark.sql.files.maxPartitionBytes`` of input, and a
    small file is one task however dear its rows are. Frames whose source tables Spark estimates
    below one such share a core in all are shuffled; larger ones stay where they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join's own estimate is a product
    estimate = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores * tasks_per_core) if estimate < cores * share else df
