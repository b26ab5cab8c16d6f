import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("ids", T.StringType()), T.StructField("_text", T.IntegerType()), T.StructField("set", T.IntegerType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with inner ones."""
    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), "x", 1, 2) for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, repeated and tied rows, a long text, unusual characters."""
    long = " ".join(f"w{i % 977}x" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \t\n "), (4, "One two three."), (4, "One two three."), (4, "tied id, other text"), (None, "no id here"),
            (None, None), (9, long), (10, "é日本 ▁ 😀 <|endoftext|> <|im_end|> 'tis  x\x00y"), (11, "one TWO three."), (12, "it's 12,5% — ok?\r\nyes")]
