import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, whole string, s int, grp string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977} line{i}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, None, "en", "a", None, "x", 1, "g"), (2, "", None, "a", 0, None, None, None), (None, base, "en", None, 1, "x", 1, "g"), (None, None, None, None, None, None, None, None),
        (5, base, "en", "a", 1, "x", 1, "g"), (5, base, "en", "a", 1, "x", 1, "g"), (6, base, "de", "b", 1, "x", 1, "g"), (7, base + " more", "de", "b", 1, "x", 1, "g"),
        (8, long, "en", "c", 1, "x", 1, "g"), (9, "one two", "en", "c", 1, "x", 1, "g"), (10, " \n\t ", "en", "c", 1, "x", 1, "g"), (11, "Été ÉTÉ naïve 日本語 \U0001f600", "fr", "é", 1, "x", 1, "g"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
