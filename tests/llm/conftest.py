import pytest

#: Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (3, None, "en", "b"), (4, "", None, None), (5, " \t\n ", "fr", "b"),
    (6, "x" * 300_000, "en", "b"), (7, "word " * 30_000, "de", "c"),
    (8, "Ein kurzer Text mit Umlauten äöü und noch mehr", "de", None),
    (9, "MIT License. Licensed under the Apache License, Version 2.0", "en", "a"),
    (9, "MIT License. Licensed under the Apache License, Version 2.0", "en", "a"),
    (9, "another text with the same id", "en", "a"),
    (None, "text without id", None, None), (None, "text without id", None, None),
    (10, "123 456 !!! ---", "en", "c"), (11, "a b　c \U0001f600 d\x00e", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every case that operators have to settle, and columns of clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as bigint) as n_chars", "1 as size", "'x' as h",
                         "2 as keep_id", "true as kept", "3 as d", "array(1) as words",
                         "'k' as key", "0 as score", "map('a', 1) as spans", "'z' as __text")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([
        (1, "quick brown fox jumps over the lazy dog near the old river bank today and then"),
        (2, "brown FOX"), (3, None), (4, ""), (None, "the lazy dog"), (2, "lazy dog")],
        "item_id long, text string")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
