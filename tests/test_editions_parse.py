"""P1-P6 edition payload parsing: recorded shapes and the coercion truth tables."""

import json

import pytest

from quire.operators import editions as E


def parse(spark, payloads):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "request_key string, payload string")
    parsed, bad = E.parse_editions(df)
    good, rejects = E.split_valid(parsed, bad)
    return good.orderBy("request_key", "item_index").collect(), rejects.collect()


def payload(items, data="2024-01-03", erro=False):
    return json.dumps({"erro": erro, "msg": "", "data": data, "numero": None, "ano": "2024", "itens": items})


def test_recorded_shapes(spark):
    p = [
        payload([{"id": 1905, "data": "03/01/2024", "suplemento": "", "numero": 3141, "tipo_edicao_id": 1,
                  "tipo_edicao_nome": "Edição Comum", "capa": 1, "paginas": 10}]),
        payload([{"id": 7727, "suplemento": 1, "numero": 25899, "tipo_edicao_id": 2, "tipo_edicao_nome": "Extra"},
                 {"id": 7725, "suplemento": 0, "numero": 25899, "tipo_edicao_id": 1, "tipo_edicao_nome": "Comum"}],
                data="2023-01-06"),
        payload([{"id": "1779", "suplemento": 0, "numero": "53", "tipo_edicao_id": "1", "tipo_edicao_nome": "x"}],
                data="2012-06-01"),
        payload([], erro=True),
    ]
    good, rejects = parse(spark, p)
    got = [(r.edition_id, str(r.publication_date), r.edition_number, r.supplement) for r in good]
    assert got == [("1905", "2024-01-03", 3141, False), ("7727", "2023-01-06", 25899, True),
                   ("7725", "2023-01-06", 25899, False), ("1779", "2012-06-01", 53, False)]
    assert [r.reason for r in rejects] == ["erro"]


def test_accented_names_decode(spark):
    good, _ = parse(spark, ['{"erro":false,"data":"2024-01-03","itens":[{"id":1,"numero":1,'
                            '"tipo_edicao_nome":"Edi\\u00e7\\u00e3o"}]}'])
    assert good[0].edition_type_name == "Edição"


SUPPLEMENT_CASES = [
    (None, False, True), ("null", False, False), ("true", True, False), ("false", False, False),
    ("0", False, False), ("1", True, False), ("2", True, False), ('""', False, False),
    ('"true"', True, False), ('"YES"', True, False), ('"1"', True, False), ('"2"', False, False),
    ("1.0", False, False), ("[]", False, False),
]


@pytest.mark.parametrize("raw,expected,missing", SUPPLEMENT_CASES)
def test_supplement_truth_table(spark, raw, expected, missing):
    item = '{"id":1,"numero":1' + ("" if missing else f',"suplemento":{raw}') + "}"
    good, _ = parse(spark, ['{"erro":false,"data":"2024-01-03","itens":[' + item + "]}"])
    assert good[0].supplement is expected


NUMBER_CASES = [
    (None, 0), ("null", None), ("53", 53), ('"53"', 53), ('" 12 "', 12), ("12.7", 12), ("true", 1),
    ('"12.5"', None), ('"x"', None),
]


@pytest.mark.parametrize("raw,expected", NUMBER_CASES)
def test_number_truth_table(spark, raw, expected):
    item = '{"id":1' + ("" if raw is None else f',"numero":{raw}') + "}"
    good, rejects = parse(spark, ['{"erro":false,"data":"2024-01-03","itens":[' + item + "]}"])
    if expected is None:
        assert good == [] and rejects[0].reason == "bad_number"
    else:
        assert good[0].edition_number == expected


@pytest.mark.parametrize("raw,reason", [
    ("{not json", "invalid_json"), ("null", "not_object"), ("{}", "no_items"),
    ('{"erro":true,"itens":[{"id":1}]}', "erro"), ('{"erro":"false","itens":[{"id":1}]}', "erro"),
    ('{"itens":[]}', "no_items"), ("[1,2]", "not_object"),
])
def test_payload_rejects(spark, raw, reason):
    good, rejects = parse(spark, [raw])
    assert good == []
    assert [r.reason for r in rejects] == [reason]


def test_item_fault_isolation(spark):
    good, rejects = parse(spark, ['{"erro":false,"data":"2024-01-03","itens":[{"id":null},{"id":5,"numero":2}]}'])
    assert [r.edition_id for r in good] == ["5"]
    assert [r.reason for r in rejects] == ["missing_id"]


def test_bad_date_is_rejected_not_fatal(spark):
    good, rejects = parse(spark, [payload([{"id": 1}], data="2024-13-45"), payload([{"id": 2}], data="2024-1-3")])
    assert [(r.edition_id, str(r.publication_date)) for r in good] == [("2", "2024-01-03")]
    assert [r.reason for r in rejects] == ["bad_date"]
