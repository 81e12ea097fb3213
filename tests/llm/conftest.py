import pytest

#: Rows that every operator on documents must take: nulls, empty, blank, very long, repeated; with columns that clash.
ODD = [
    (1, "the cat sat on the mat and looked at the dog"),
    (1, "the cat sat on the mat and looked at the dog"),
    (2, None),
    (None, "text without an id, 4111 1111 1111 1111"),
    (None, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "!!! ??? ..."),
    (6, "word " * 20_000),
    (7, "x" * 300_000),
    (8, "日本語 größe " * 50),
    (9, "\n\n\n"),
    (10, "the cat sat on the mat and looked at the dog"),
    (11, "a\x00b\r\nc"),
]
CLASHING = "id bigint, text string, lang string, source string, n_chars bigint, gram bigint, pos int, doc bigint, sig string, keys string, node bigint, root bigint, words int, anchors string, language string, entropy double, place int, n bigint, rep bigint, key string, doc_id bigint, n_tokens bigint"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = [(77, t, "en", None, None, 1, 1, 1, "s", "k", 1, 1, 1, "a", "l", 0.0, 1, 1, 1, "k", i, 1) for i, t in ODD]
    return spark.createDataFrame(rows, CLASHING).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
