"""Connected components over an edge table, by alternating large-star and small-star.

Each round moves every neighbour of a node to the smallest node it knows; the rounds grow
with the logarithm of the longest path. Edges and minima are written in the shared folder
between the steps, so a hot root is joined from two shuffles that Spark can split, and
nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, release


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two bigint columns ``a, b``. Returns ``node, root`` for every node with an
    edge to another node; the root is the smallest node of the component. Null ends and
    self-links are ignored; an empty edge table gives an empty result."""
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    e = materialize(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.where("v > u").join(m, "u")
                            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        m2 = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "minima")
        j = large.join(m2, "hi")
        new = materialize(j.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                          .unionByName(m2.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        new_state = _state(new)
        for t in (e, m, large, m2):
            release(t)
        e, old, state = new, state, new_state
        if state == old:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
