import os

import pytest
from pyspark.sql import functions as F

from quire.llm.common import join_groups, materialize, scratch


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark) as kept:
        a, b = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
        kept.append(b)
    at = lambda df: df._quire_path.removeprefix("file:")
    assert not os.path.exists(at(a)) and b.count() == 7
    with pytest.raises(ValueError), scratch(spark):
        c = materialize(spark.range(3), "c")
        raise ValueError
    assert c.count() == 3  # a block that fails keeps its tables


def test_join_groups_with_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = join_groups(rows, groups, "k", "n", 6000)
    assert got.count() == 6000 and got.where("k = -1").select("n", "m").distinct().collect()[0] == (2000, 5997)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
