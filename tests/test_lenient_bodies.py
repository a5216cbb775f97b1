"""No body stops a job, no text is damaged."""

from pyspark.sql import functions as F

from quire.operators import content as C
from quire.operators import editions as E


def _parse(spark, payloads, header=None):
    df = spark.createDataFrame([("m", str(i), header, p) for i, p in enumerate(payloads)],
                               "municipality string, request_key string, content_type_header string, body binary")
    parsed, bad = E.parse_editions(df, payload="body")
    good, rejects = E.split_valid(parsed, bad)
    return ([(r.request_key, r.edition_id, r.edition_type_name) for r in good.orderBy("request_key", "edition_id").collect()],
            sorted((r.request_key, r.reason) for r in rejects.collect()))


def test_bad_items_cost_only_themselves(spark):
    ok = '{"id":7,"tipo_edicao_nome":"x"}'
    head = '{"data":"2024-01-02","itens":['
    good, rejects = _parse(spark, [(head + s + "]}").encode() for s in (
        f"1,{ok}", f'"x",{ok}', f"null,{ok}", f"[2],{ok}", f'{{"numero":null,"id":1}},{ok}')])
    assert good == [(str(i), "7", "x") for i in range(5)]
    assert rejects == [("0", "item_not_object"), ("1", "item_not_object"), ("2", "item_not_object"),
                       ("3", "item_not_object"), ("4", "bad_number")]


def test_white_space_error_lists_and_other_charsets(spark):
    body = '{"data":"2024-01-02","itens":[{"id":7,"tipo_edicao_nome":"Edição"}]}'
    good, rejects = _parse(spark, [("\r\n\t " + body).encode(), ("﻿" + body).encode(),
                                   body.replace('{"data"', '{"erro":[null],"data"').encode(), b"\xff\xfe\xfd"])
    assert [g[0] for g in good][:1] == ["0"] and ("2", "erro") in rejects and ("3", "not_object") in rejects
    good, _ = _parse(spark, [body.encode("latin-1")], "application/json; charset=ISO-8859-1")
    assert good == [("0", "7", "Edição")]
    good, _ = _parse(spark, [body.encode("latin-1")])  # wrong charset: replaced, not failed
    assert good == [("0", "7", "Edi��o")]


def test_content_charsets(spark):
    cases = [("windows-1252", "“aspas” – € ção".encode("cp1252"), "“aspas” – € ção"), ("cp1252", b"\x81\x80", "\x81€"),
             ("iso-8859-1", "ção".encode("latin-1"), "ção"), ("utf-16le", "ção".encode("utf-16-le") + b"x", "ção�"),
             ("utf-16be", b"\x00a\xd8\x00", "a�"), ("utf-8", b"a\xffb", "a�b"), ("klingon", "é".encode(), "é"),
             ("utf-16", "é".encode("utf-16"), "é")]
    df = spark.createDataFrame([(str(i), f"text/html; charset={c}", b) for i, (c, b, _) in enumerate(cases)],
                               "request_key string, content_type_header string, body binary")
    got = {r.request_key: r.text for r in C.dispatch(df).select("request_key", "text").collect()}
    assert got == {str(i): t for i, (_, _, t) in enumerate(cases)}
    assert spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "false"


def test_blobs_plan_is_narrow_below_the_aggregate(spark):
    df = spark.createDataFrame([(str(i), "text/plain", ("x%d" % (i % 2) * 3000).encode()) for i in range(5)],
                               "request_key string, content_type_header string, body binary")
    split = C.split_inline(C.dispatch(df))
    blobs = C.new_blobs(split)
    assert "SortAggregate" not in blobs._jdf.queryExecution().executedPlan().toString()
    rows = blobs.collect()
    assert len(rows) == 2 and {bytes(r.content) for r in rows} == {b"x0" * 3000, b"x1" * 3000}
    known = blobs.where(F.col("content_hash") == rows[0].content_hash)
    assert C.new_blobs(split, known).count() == 1
