import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", 3, 7, "x"), (2, "", None, "a", 0, 7, "x"), (3, " \n\t ", "en", None, 3, 7, "x"),
        (4, "one two", "en", "a", None, 7, "x"), (5, "one two", "en", "a", 7, 7, "x"), (5, "one two", "en", "a", 7, 7, "x"),
        (6, "word " * 30000, "en", "b", 5, 7, None), (None, "a text without an id", "de", "b", 5, None, "x"),
        (7, "ünï 12 çödé 😀 text", None, None, None, 7, "x"), (8, "123 456 789", "en", "a", 11, 7, "x"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component long, kept string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.where("false")
