import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, _lost string, copies string, component string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names that the operators use."""
    long = "word%d " * 1
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 4), (4, "one", "en", "a", 3), (None, "a text without an id, but with some words in it", "en", "b", 1),
        (5, "same words in both of these rows, twice over", "en", "b", 1), (5, "same words in both of these rows, twice over", "en", "b", 1), (6, "same words in both of these rows, twice over", "fr", "b", 1),
        (7, "".join(f"{long % i}" for i in range(30000)), "de", "c", 1), (8, "x" * 100_000, None, None, None), (9, "\U0001f600 é \u0000 tab\there 4111 1111 1111 1111 a@b.co", "es", "c", 2),
    ]
    return spark.createDataFrame([(*r, "h", "l", "c", "k") for r in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
