import pytest

SCHEMA = "doc_id long, text string, source string, kept boolean, size long, score double, id string"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "a"), (2, "the QUICK brown fox jumps over the lazy dog again", "a"), (3, None, None), (4, "", "b"), (5, " \n\t", "b"),
    (6, "one", "b"), (7, "One", "c"), (8, LONG, "c"), (9, LONG + " end", "a"), (9, LONG + " end", "a"), (10, "x" * 5000, None), (11, "Été Ünï   日本語 text with several words here", "a"),
    (None, "no id at all but some words to read", "a"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns whose names clash."""
    return spark.createDataFrame([(a, b, c, True, 1, 0.5, "z") for a, b, c in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 12)], "doc_id long, quality int, toxic int")
