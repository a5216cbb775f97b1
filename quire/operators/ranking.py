"""Positions inside a group without one task per group.

A window over a group sorts all its rows in one task. Here the rows are range partitioned by
group and order, so a hot group spans many partitions; each partition numbers its own piece of
a group, and the sizes of the pieces before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir


def numbered(df: DataFrame, key: list[str], order: list[str], index: str = "_index") -> DataFrame:
    """``df`` with the 0-based position of each row among those of equal ``key``, by ``order``.

    The range partitions come from a sample, so they are fixed by a checkpoint before they are
    used twice. A partition boundary lies in one group at most: the pieces that need an offset
    are fewer than two a partition, and are broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    pieces = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.withColumn("_before", F.sum("_n").over(before)).where("_before is not null")
               .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), "_before"))
    own = Window.partitionBy(*key, "_part").orderBy(*order)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (dealt.withColumn("_own", F.row_number().over(own)).join(F.broadcast(offsets), same, "left")
            .withColumn(index, F.col("_own") - 1 + F.coalesce("_before", F.lit(0)))
            .drop("_part", "_own", "_p", "_before", *[f"_k{i}" for i in range(len(key))]))
