import pytest

#: Rows that every text operator has to take: nulls anywhere, empty, blank, long, repeated, odd.
ODD = [
    (1, None, "en", None, None), (None, "a text without a key", None, "s", 3), (2, "", "en", "s", 0),
    (3, " \t\n\x0b ", None, "s", 4), (4, "word " * 30_000, "en", "s", 150_000),
    (5, "the same row of words twice", "en", "s", 1), (5, "the same row of words twice", "en", "s", 1),
    (6, "naïve 中文 😀 <|endoftext|> x y", "fr", "s", 1), (7, "one", "de", "s", 3),
    (8, "the\nthe\n\nthe\n", "en", "s", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("key", "line", "sig", "kept", "near", "leaks", "row", "fp", "block", "body", "_key", "_size",
            "_shard", "_words", "label", "score", "k", "t", "n", "first", "drop", "others")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, COLUMNS)
    return rows.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
