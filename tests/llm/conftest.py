import pytest

from noteframe.llm import common


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship_code(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and columns with clashing names."""
    base = " ".join(f"word{i} stays here" for i in range(60))
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), "en", None),
            (3, base + " and a little more", None, "b"), (4, "", "en", "b"), (5, None, "en", "b"), (None, base, "en", "a"),
            (6, "two words", "en", "c"), (7, "\n\n \n", "en", "c"), (8, "é" * 70 + "\n" + "é" * 70, "fr", "c"),
            (9, " ".join(f"w{i % 977}x{i}" for i in range(30000)), "en", "a"), (10, "two  words", "de", "a"),
            (None, None, None, None)]
    rows = [r + (i, "x", 1.5, b"z", "t") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "bucket string, key double, data binary, _text string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
