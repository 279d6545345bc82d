import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as documents, with columns whose names could clash."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token string, n int")

    return make
