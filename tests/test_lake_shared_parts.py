"""What the three tables of a corpus share is stored once, without bodies, and deleted after."""

import os

from pyspark.sql import functions as F

from quire.plans.ingest import build_corpus
from quire.sinks import lake


def left_behind(spark):
    return {n for n in os.listdir(spark.conf.get("spark.checkpoint.dir")) if n.startswith("corpus-")}


def test_the_shared_parts_hold_no_bodies_and_give_the_same_tables(spark, sf_small, tmp_dir):
    before, want = left_behind(spark), build_corpus(spark, sf_small)
    c = build_corpus(spark, sf_small).materialize()
    stored = [c._unique, c._counted]
    assert all("inline_text" not in f.columns and f.inputFiles() for f in stored)
    # an exchange to the files holds no digest and no copy of the path: they are derived behind it
    assert not {"edition_hash", "hierarchy_path_json"} & set(c.rows("articles").columns)
    for name in ("editions", "articles", "relationships"):
        a, b = getattr(c, name), getattr(want, name)
        assert a.columns == b.columns and a.count() == b.count() > 0
        assert a.exceptAll(b).count() == 0
    lake.write_corpus(spark, c, tmp_dir, "b1", granularity="year")
    assert left_behind(spark) == before
    for name in ("editions", "articles", "relationships"):
        got, b = lake.read_table(spark, tmp_dir, name).drop("batch_id", "processed_at"), getattr(want, name)
        assert got.select(*b.columns).exceptAll(b).count() == 0 and got.count() == b.count()
    assert c.articles.count() == want.articles.count()  # still usable: from the inputs


def test_a_key_answered_twice_counts_twice(spark, tmp_dir):
    from quire.operators import content as C
    from quire.plans.ingest import Corpus
    eds = spark.createDataFrame([("m", 1, "2020-01-02"), ("m", 2, "2020-01-03")], "municipality string, edition_id bigint, d string").select(
        "municipality", "edition_id", F.to_date("d").alias("publication_date"), F.lit(1).alias("edition_number"), F.lit(False).alias("supplement"),
        F.lit(1).alias("edition_type_id"), F.lit("x").alias("edition_type_name"))
    links = spark.createDataFrame([("m", 1, 11, 7, "t", "p", 1, ["a"], 0), ("m", 1, 12, 7, "t", "p", 2, ["a", "b"], 1), ("m", 2, 21, 8, "t", None, 1, ["a"], 2)],
                                  "municipality string, edition_id bigint, article_id bigint, identifier bigint, title string, protocol string, "
                                  "depth int, hierarchy_path array<string>, ord int")
    body = spark.createDataFrame([(7, "text/plain", b"one"), (7, "text/plain", b"two"), (9, "text/plain", b"x")],
                                 "request_key bigint, content_type_header string, body binary")
    split = C.split_inline(C.dispatch(body))
    s = lake.write_corpus(spark, Corpus(spark, eds, links, split), tmp_dir, "b1", granularity="year")
    assert (s["editions"], s["articles"], s["relationships"]) == (2, 2, 2)
    a = lake.read_table(spark, tmp_dir, "articles").orderBy("inline_text").collect()
    assert [(r.article_id, r.inline_text) for r in a] == [("12", "one"), ("12", "two")]
    e = lake.read_table(spark, tmp_dir, "editions").orderBy("edition_id").collect()
    assert [(r.edition_id, r.total_articles) for r in e] == [("1", 2), ("2", 0)]
    assert {r.edition_hash for r in a} == {e[0].edition_hash}
