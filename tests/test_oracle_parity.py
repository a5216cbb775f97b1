"""Every registered query against its DuckDB SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from quire.plans import catalog
from tests.oracle_check import compare, duck_connect

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    return duck_connect(sf_small)


def test_every_query_has_sql():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == [], f"queries without an oracle: {missing}"
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_small, duck, name):
    r = compare(spark, name, QUERIES[name], SQL[name], sf_small, duck)
    assert r["ok"], r.get("why")


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["year", "num_articles", "total_size", "total_size_gb"]
