"""P11-P14 content dispatch (FIXTURES §4), S2 calendar, F3/F4 retry rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import content as C
from quire.operators import fetchlog as FL
from quire.operators.frontier import get_workdays


def dispatch(spark, rows):
    df = spark.createDataFrame([(str(i), h, b) for i, (h, b) in enumerate(rows)],
                               "request_key string, content_type_header string, body binary")
    return C.split_inline(C.dispatch(df)).orderBy("request_key").collect()


def test_mime_dispatch(spark):
    rows = dispatch(spark, [
        ("Application/PDF; x=1", b"%PDF-\xff\xfe"),
        ("application/pdf", b"plain ascii"),
        ("application/json; charset=UTF-8", b'{"conteudo":"<p>x</p>"}'),
        ("application/json", b"{}"),
        ("application/json", b'{"conteudo":null}'),
        ("application/json", b"[1,2]"),
        ("text/html; charset=ISO-8859-1", b"\xe7"),
        ("text/plain", b"hello"),
        (None, b"hi"),
    ])
    got = [(r.content_type, r.text, r.reason) for r in rows]
    assert got[0] == ("pdf", None, None) and rows[0].is_blob and rows[0].content_size == 7
    assert got[1] == ("pdf", "plain ascii", None) and not rows[1].is_blob
    assert got[2] == ("html", "<p>x</p>", None)
    assert got[3] == ("html", "", None) and got[4] == ("html", "", None)
    assert got[5][2] == "invalid_json"
    assert got[6] == ("html", "ç", None) and rows[6].content_size == 2
    assert got[7] == ("text", "hello", None) and got[8] == ("text", "hi", None)


def test_inline_threshold_counts_characters(spark):
    rows = dispatch(spark, [("text/plain", ("ç" * 2000).encode()), ("text/plain", ("ç" * 2001).encode())])
    assert (rows[0].is_blob, rows[0].content_size, rows[0].content_hash) == (False, 4000, None)
    assert rows[1].is_blob and rows[1].content_size == 4002
    h = rows[1].content_hash
    assert rows[1].content_path == f"content/{h[:2]}/{h[2:4]}/{h}.bin"


def test_blob_dedupe_and_skip_existing(spark):
    big = ("x" * 3000).encode()
    df = spark.createDataFrame([("a", "text/plain", big), ("b", "text/plain", big),
                                ("c", "text/plain", ("y" * 3000).encode())],
                               "request_key string, content_type_header string, body binary")
    split = C.split_inline(C.dispatch(df))
    assert C.new_blobs(split).count() == 2
    existing = C.new_blobs(split).where(F.col("content_size") > 0).limit(1).select("content_hash")
    assert C.new_blobs(split, existing).count() == 1


@pytest.mark.parametrize("start,end,expected", [
    (dt.date(2024, 1, 3), dt.date(2024, 1, 5), 3),
    (dt.date(2023, 1, 2), dt.date(2023, 1, 4), 3),
    (dt.date(2012, 6, 26), dt.date(2012, 6, 30), 4),
    (dt.date(2012, 5, 29), dt.date(2012, 6, 4), 5),
    (dt.date(2022, 1, 1), dt.date(2022, 1, 5), 3),
    (dt.date(2022, 1, 5), dt.date(2022, 1, 1), 0),
])
def test_workdays(spark, start, end, expected):
    assert get_workdays(spark, start, end).count() == expected


def test_workdays_holidays_and_datetimes(spark):
    days = get_workdays(spark, dt.datetime(2024, 1, 1, 15, 0), dt.date(2024, 1, 5), holidays=[dt.date(2024, 1, 1)])
    assert [r.d for r in days.collect()] == [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]


def test_retry_rules(spark):
    df = spark.createDataFrame([(s,) for s in (200, 500, 503, 429, 408, 404, 400, 0)], "status int")
    got = {r.status: r.a for r in df.select("status", FL.triage(F.col("status")).alias("a")).collect()}
    assert got == {200: "ok", 500: "retry", 503: "retry", 429: "retry", 408: "retry", 404: "give_up",
                   400: "give_up", 0: "retry"}
    waits = spark.range(1, 7).select(FL.backoff_seconds(F.col("id")).alias("w")).collect()
    assert [r.w for r in waits] == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0]
    sched = FL.retry_schedule(df).where("status = 503").orderBy("attempt").collect()
    assert [(r.attempt, r.next_attempt, r.wait_s) for r in sched] == [(1, True, 1.0), (2, True, 2.0), (3, False, 0.0)]
