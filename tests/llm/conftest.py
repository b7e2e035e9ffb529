import pytest

#: Nulls, empty and blank texts, repeated rows, ties, a very long text.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "a", "two words", "é ß 🤖 ñ", "x" * 60_000, "word " * 20_000, "tab\tand\x0bfeed\x0c", "line one\nline two\nline one"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names clash with those of the operators."""
    rows = [(i, t, "kept", 1.0) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", None, None), (5, "a", "kept", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, ratio double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
