import pytest


@pytest.fixture()
def docs(spark):
    """Rows with nulls, empty and repeated texts, repeated and null keys, and columns with clashing names."""

    def make(rows, key="doc_id"):
        schema = f"{key} bigint, text string, lang string, source string, n_chars bigint, content int, n int, key string, component int"
        return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, 2, "x", 3) for k, t in rows], schema)

    return make
