import pytest

@pytest.fixture(scope="session")
def frame(spark):
    """rows -> DataFrame with the columns of documents (more columns by keyword)."""
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        names = [c.split()[0] for c in schema.split(", ")]
        full = [tuple(list(r) + [None] * (len(names) - len(r))) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
