import pytest

LONG = "word " * 6000 + "x" * 5000
TEXTS = [None, "", "   \n\t ", "a", "a", "One two three four five six seven eight nine ten eleven.", "One two three four five six seven eight nine ten eleven.", "é日本 😀 <|endoftext|> it's  they'll\n\n x", LONG, LONG, "line\nline\nline two words here and more of them to be counted now\n"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null key, and columns whose names clash with outputs."""
    rows = [(i if i < 10 else None, t, "en" if i % 2 else None, f"s{i % 2}", i) for i, t in enumerate(TEXTS)] + [(3, "a", "en", "s1", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score bigint").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
