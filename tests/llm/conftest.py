import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "One two three four five six seven.", "en", "a"), (1, "One two three four five six seven.", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "text without an id", "en", "b"), (4, LONG, "en", "a"), (5, " \n\t ", "en", "b"), (6, "Ünïcode 漢字 😀 <|endoftext|> end", "de", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", "length(text) as n_chars", "1 as row", "2 as group", "3 as copy", "'x' as shuffle_key", "0.5 as quality_score", "7 as length", "8 as n", "9 as piece")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1, 7)] + [(None, 1, 1), (3, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
