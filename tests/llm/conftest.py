import pytest


@pytest.fixture
def frame(spark):
    """A table of documents from (doc_id, text) rows, with a column whose name clashes with inner names."""
    return lambda rows: spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row_no string").repartition(3)
