import pytest

LONG = "word " * 30_000
ROWS = [
    (1, "Same text here, all of it. " * 4, "en", "a"), (2, "Same text here, all of it. " * 4, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, LONG, "en", "a"), (6, LONG, "de", None),
    (None, "a row without an id", "en", "a"), (7, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567 now", "en", "a"), (7, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567 now", "en", "a"), (8, "\n\n \t\n", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and extra columns whose
    names operators might use themselves."""
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' AS node", "1 AS salt", "2.0D AS score", "'y' AS key", "'z' AS text_sha256", "array(1) AS ids", "0 AS rank")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
