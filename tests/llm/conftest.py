import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Builds a frame of ``doc_id, text`` with extra columns whose names clash with internal ones."""

    def build(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            for name in ("key", "h", "body", "spans", "part", "node", "fp", "bucket", "html_"):
                df = df.withColumn(name, df["doc_id"])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null and empty texts, repeated rows, equal texts, one word, no word, a very long text."""
    long_ = " ".join(f"w{i % 977} é{i % 31}" for i in range(40_000))
    return [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, " \n\t "), (None, "x y"), (6, "word"), (7, long_), (8, long_)]


