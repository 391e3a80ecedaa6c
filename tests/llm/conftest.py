import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with a column whose name clashes with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None, "clash") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Texts that every operator must take.
ODD = [None, "", " \t\n", "a", "é", "x" * 30_000, "word " * 4000, "tab\tand\x0bvt\x1cfs nbsp　wide", "<|endoftext|> it's WE'RE 'll 123 ٣ 中文 😀"]
