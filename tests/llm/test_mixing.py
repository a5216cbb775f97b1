import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.llm.mixing import mix, mixed_documents, pivot, told_apart


def slow_targets(size, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = share * sum(size.values()), {}, set(names)
    if not sum(size.values()):
        return dict.fromkeys(names, 0.0)
    while True:
        rest = total - sum(target.values())
        now = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if now[s] >= 2 * size[s]}
        if not over:
            return target | now
        target |= {s: 2.0 * size[s] for s in over}
        free -= over


def rows_of(n=3000, seed=1):
    rnd = random.Random(seed)
    src = ["hot"] * 6 + ["ä", "a", "B", "zz", None, "", "q1", "q2"]
    return [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 5, 50, 200]))), "en", rnd.choice(src))
            for i in range(n)]


def test_pivot_keeps_mass_and_expectation():
    size, p0 = np.array([5, 1, 9, 30, 2, 7, 4, 4]), np.array([.5, .2, .7, .3, .9, .5, .1, .6])
    got = []
    for s in range(4000):
        p, left = pivot(size, p0, np.random.default_rng(s))
        assert abs((p * size).sum() - (p0 * size).sum()) < 1e-9
        assert sum((p > 0) & (p < 1)) <= 1
        got.append(p)
    assert np.abs(np.mean(got, axis=0) - p0).max() < .04


def test_targets_and_totals(spark, frame):
    rows = rows_of()
    df = frame(rows).withColumn("size", F.lit("clash")).withColumn("chunk", F.lit(1))
    out = mix(df, chunk=128, fan_in=4).toPandas()
    assert len(out) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = slow_targets(size)
    out["source"] = out["source"].where(out["source"].notna(), None)
    for s, g in out.groupby(out["source"].map(lambda x: "none" if x is None else "s" + x)):
        key = None if s == "none" else s[1:]
        assert (g["source_size"] == size[key]).all()
        assert np.allclose(g["target"], want[key])
        assert abs(g["taken"].sum() - want[key]) <= g["size"].max()
        assert g["copies"].isin([np.floor(want[key] / size[key]), np.ceil(want[key] / size[key])]).sum() >= (g["size"] > 0).sum()
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mix(df.repartition(7), chunk=128, fan_in=4).toPandas()
    key = ["doc_id", "dup"]
    pd.testing.assert_series_equal(out.sort_values(key).taken.reset_index(drop=True),
                                   again.sort_values(key).taken.reset_index(drop=True))


def test_repeated_rows_nulls_and_output_rows(spark, frame):
    rows = [(1, "a b c", "en", "s")] * 40 + [(None, "x y", None, None), (2, None, "de", "s"), (3, "", "de", "t")]
    df = frame(rows)
    m = mix(df).toPandas()
    assert len(m) == 43 and m["taken"].sum() > 0
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert out.count() == m["copies"][m["size"] > 0].sum() + m["copies"][m["size"] == 0].sum()
    assert mix(df.where("false")).count() == 0
    assert set(mix(df.where("doc_id > 1")).toPandas()["taken"]) == {0}


def test_equal_rows_are_told_apart_in_pieces(spark):
    rows = [(1, 9, "s", 3)] * 2000 + [(1, 9, None, 3)] * 3 + [(None, 9, "s", 3)] * 2 + [(2, 9, "s", 3), (2, 8, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, th bigint, source string, size bigint")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are left as they are
    try:
        out = told_apart(df, alike=50).withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert out.groupby("part").size().max() < 1000
    out["source"] = out["source"].where(out["source"].notna(), None)
    got = sorted(out[["doc_id", "th", "source", "size", "dup"]].fillna({"doc_id": -1, "source": ""}).itertuples(index=False, name=None))
    want = [(-1, 9, "s", 3, i) for i in (1, 2)] + [(1, 9, "", 3, i) for i in (1, 2, 3)]
    want += [(1, 9, "s", 3, i) for i in range(4, 2004)] + [(2, 8, "s", 4, 1), (2, 9, "s", 3, 1)]
    assert got == sorted(want)
    assert told_apart(df.where("false")).count() == 0


def test_mixed_documents_take_what_the_mix_says(spark):
    rnd = random.Random(3)
    rows = [(1, "a b c", "s", i) for i in range(900)] + [(1, "a b c", None, -1), (None, "a b c", "s", -2), (2, None, "s", -3)]
    rows += [(i, "w " * rnd.randrange(1, 30), rnd.choice(["s", "t", "u", None]), i) for i in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _key int")
    m = mix(df, chunk=64, fan_in=4).toPandas()
    want = m.assign(doc_id=m["doc_id"].fillna(-1), source=m["source"].fillna("-")).groupby(["doc_id", "source", "size"])["copies"].sum()
    out = mixed_documents(df, chunk=64, fan_in=4)
    assert out.columns == df.columns
    out = out.toPandas()
    out["size"] = out["text"].fillna("").str.split().map(len)
    got = out.assign(doc_id=out["doc_id"].fillna(-1), source=out["source"].fillna("-")).groupby(["doc_id", "source", "size"]).size()
    assert got.to_dict() == want[want > 0].to_dict()
    same = m[(m["doc_id"] == 1) & (m["source"] == "s")]["copies"]
    times = out[(out["doc_id"] == 1) & (out["source"] == "s")].groupby("_key").size().reindex(range(900), fill_value=0)
    assert sorted(times) == sorted(same) and same.nunique() == 2
