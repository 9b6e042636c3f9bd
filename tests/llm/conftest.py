import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 4000
BASE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, BASE, "en", "a", 1, 7, "x"),
        (1, BASE, "en", "a", 1, 7, "x"),
        (2, BASE + " tail", "en", "a", 1, 7, "x"),
        (3, None, "en", "b", None, 8, "x"),
        (4, "", None, None, 0, None, None),
        (None, "only one of its kind", "de", "c", 20, 1, "y"),
        (None, None, None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG), 1, "y"),
        (6, "  two  spaces\n\n▁mark é 😀\x00 " + "x" * 3000, "fr", "c", 9, 1, "y"),
        (7, " \n\t ", "fr", "c", 4, 1, "y"),
        (8, BASE + "\n" + BASE + "s", "en", "z", 1, 1, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, row string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
