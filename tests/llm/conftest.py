import pytest

DATA = "/root/testdata/sf0.001"

#: Nulls, empty and wordless texts, a long text, ties, repeated rows, and columns whose names operators use themselves.
ODD = [
    (1, None, "en", None, 1), (None, "a few words without an id", "en", "s", 2), (2, "", "de", "s", 3), (3, " \n\t ", "de", "s", 4),
    (4, "the same words stand here again and again the same words stand here", "en", "s", 5), (4, "the same words stand here again and again the same words stand here", "en", "s", 5),
    (5, "The Same words stand here again and again the same words stand here", "en", "t", 6), (6, "one two", "en", "t", 7), (7, "ONE TWO", "en", "t", 8),
    (8, "ünïcode ß 日本語 \x00 <|endoftext|> </s> ▁ İ", "xx", "t", 9), (9, "word " * 30000, "en", "big", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *(F.lit("clash").alias(c) for c in ("rid", "n", "score", "size", "media", "_text", "_words", "position", "piece", "label", "signature", "bucket")))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
