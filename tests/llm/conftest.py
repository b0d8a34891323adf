import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs or whole rows."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([r if len(r) == 5 else (r[0], r[1], lang, source, len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table and its rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [tuple(r) for r in df.collect()]


#: Texts that no operator may stumble over.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (None, None),
    (6, "ÄÖ ß 日本 🎉 İ ΑΣ é"), (7, "x" * 30_000), (8, "a b c " * 4_000), (9, "one\x0btwo\x0cthree\rfour\x85five six"),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
