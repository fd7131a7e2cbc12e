import pytest


@pytest.fixture
def make(spark):
    """Rows -> DataFrame of documents with columns that nobody asked for."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return build
