import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup as X
from quire.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_check import compare, duck_connect


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def marked(df):
    return sorted((tuple(r) for r in X.mark(df).collect()), key=str)


def test_matches_brute_force_with_a_hot_text(spark, frame):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", None, "", f"text {rng.randrange(900)}", "x" * 5000 + str(rng.randrange(3))])) for i in range(3000)]
    assert marked(frame(rows)) == brute(rows)


def test_query_matches_sql(spark, sf_small):
    r = compare(spark, "op11_exact_dedup", QUERIES["op11_exact_dedup"], ORACLE_SQL["op11_exact_dedup"], sf_small, duck_connect(sf_small))
    assert r["ok"], r.get("why")


def test_filter_flags_every_copy_and_few_others(spark, frame):
    rows = [(i, f"text {i}") for i in range(4000)] + [(9000 + i, f"text {i}") for i in range(0, 4000, 100)]
    keys = frame(rows).select(X.text_key(F.col("text")).alias("key"))
    bloom, blocks = X.repeat_filter(keys, len(rows))
    got = X.probe(keys, bloom, blocks)
    flagged = got.where("maybe").count()
    assert blocks > 1 and 80 <= flagged < 200  # 80 rows have a copy
    assert got.where("not maybe").distinct().count() == len(rows) - flagged


def test_repeated_rows_null_ids_and_empty_tables(spark, frame):
    rows = [(3, "a"), (3, "a"), (None, "b"), (None, "b"), (None, "a"), (1, None), (2, "")]
    got = X.mark(frame(rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(got) == len(rows) and all(sum(r.kept for r in g) == 1 for g in by.values())
    assert {(r.id, r.keep_id, r.group_size) for r in got} == {(3, 3, 3), (None, 3, 3), (None, None, 2), (1, 2, 2), (2, 2, 2)}
    assert X.mark(frame([])).count() == 0 and X.dedup(frame([])).count() == 0


def test_dedup_keeps_whole_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 10, "p"), (2, "a", 20, "q"), (3, "B", 30, "r"), (4, "b", 40, "s")],
                               "doc_id bigint, text string, key int, maybe string")
    assert sorted(map(tuple, X.dedup(df).collect())) == [(2, "a", 20, "q"), (3, "B", 30, "r"), (4, "b", 40, "s")]
    assert sorted(r.doc_id for r in X.dedup(df, normalize=F.lower).collect()) == [2, 4]
    wide = df.withColumnsRenamed({"key": "rid", "maybe": "block"}).withColumn("bits", F.lit(1))
    assert X.dedup(wide).columns == wide.columns and X.mark(wide).count() == 4


def test_only_possible_copies_are_shuffled(spark, frame):
    rows = [(i, f"text {i}") for i in range(500)]
    plan = X.dedup(frame(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tables(spark, frame, n):
    assert [r.group_size for r in X.mark(frame([(i, "t") for i in range(n)])).collect()] == [n] * n
