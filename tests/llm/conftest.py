import pytest

from grainmill.plans.tables import table


@pytest.fixture(scope="session")
def documents(spark, data):
    return table(spark, data, "documents")


ODD = "doc_id long, text string, lang string, source string, n_chars long, n int, cls long, id long, token string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and columns whose names clash with inner ones."""
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long_), (5, near), (6, near + " tail"), (6, near + " tail"), (7, "one two three"), (8, "ONE two\nthree"), (9, "é ß   ö"), (10, long_)]
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "t") for i, t in rows], ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
