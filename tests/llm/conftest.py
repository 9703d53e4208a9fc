import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, token string, size string, n string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while nine other animals watch from the far side of the river"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "  \t\n\x0b ", "en", "b"),
        (6, "one two", "en", "c"), (7, "one two", "fr", "c"), (None, base, None, None), (None, None, None, None), (8, "wort " * 20000, "de", "d"),
        (8, base + " twice", "de", "d"), (9, "line one of this text is here\n" * 3, "fr", "d"), (10, "42 17 !!", "en", "e"),
    ]
    return spark.createDataFrame([(i, t, lang, s, 7, "k", 1, "t", "s", "n") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
