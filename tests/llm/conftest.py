import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty and a long text, ties, a repeated row, and extra columns with names that operators use themselves."""
    long = " ".join(f"w{i % 700}" for i in range(30000))
    rows = [(1, "a b c d e f g", "x"), (2, "", "x"), (3, None, None), (None, "a b c d e f g", "y"), (4, long, "z"), (5, "a b c d e f g", "x"), (5, "a b c d e f g", "x"), (6, "Ünï ça là 漢字 \t\n", None)]
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, fp string, n int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
