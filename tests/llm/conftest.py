import pytest

ODD = [
    (1, None), (2, ""), (3, "one"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "null key text here with words"), (None, None),
    (7, " \t\n\x0b\x0c\r "), (8, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (9, "é ▁ 日本語 \x00 😀  two  spaces\n"), (10, "w" * 5000), (11, "ab " * 3000),
    (12, "x\ny\nz"), (13, "reach me at a.b@mail.example.com or +1 (523) 555-1055, 10.0.0.1, 4111 1111 1111 1111"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated, long and foreign texts, with columns whose names clash with inner ones."""
    rows = [(i, t, "en", i, "r", 1, b"k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, pos long, row string, n int, digest binary")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
