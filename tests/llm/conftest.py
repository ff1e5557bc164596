import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000)) + "."
BASE = " ".join(f"tok{i}" for i in range(200))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows, marks of many kinds."""
    near = BASE.replace("tok150", "other")
    return [
        (1, "Hello, world. Mail a.b@c.example.org or +1 (262) 555-3752", "en", "s1"), (2, None, "en", "s1"), (3, "", "fr", "s2"), (4, "   \n\t ", None, "s2"),
        (5, LONG, "en", None), (6, BASE, "en", "s1"), (7, BASE, "en", "s1"), (8, near, "en", "s1"), (8, near, "en", "s1"), (9, BASE.upper(), "en", "s1"),
        (10, "12345 !!! 678", "de", "s3"), (None, "null id", "de", "s3"), (11, "naïve café — ñandú 你好 😀 e\u0301", "fr", "s3"), (12, "<|endoftext|> A<|endoftext|>b", "en", "s3"),
        (13, "one two  three", "en", "s3"), (14, "one two three", "en", "s3"), (15, "A\u00a0B\x00C\x1cD", "en", "s3"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with those that operators add."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr(
        "*", "0 AS n", "0 AS node", "'x' AS score", "1 AS predicted", "'y' AS lang_pred", "1 AS kept", "'z' AS keep_id", "9 AS copy", "2 AS copies", "3 AS component_id", "4 AS segments", "5 AS size", "6 AS token"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id < -5")
