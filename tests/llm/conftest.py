import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, or of whole rows."""

    def make(rows):
        full = [(*r, "en", f"src{i % 3}", len(r[1] or "")) if len(r) == 2 else tuple(r) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
