import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, a very long one, copies, near copies, ties and repeated rows.
LONG = "lorem ipsum dolor " * 90_000
BASE = " ".join(f"word{k % 97}x{k}" for k in range(400))
ROWS = [
    (1, "The cat sat, on the mat. The dog ran.", "en", "a", 37),
    (2, "", "en", "a", 0),
    (3, None, "en", "b", None),
    (4, "  \t\n ", None, "b", 5),
    (5, LONG, "xx", "c", len(LONG)),
    (6, BASE, "en", None, len(BASE)),
    (7, BASE, "en", "a", len(BASE)),
    (8, BASE.replace("word3x3", "other"), "en", "a", None),
    (9, "Straße über Größe 中文 ▁mark 😀\x00end", "de", "c", 30),
    (10, "x" * 5000, "en", "c", 5000),
    (10, "x" * 5000, "en", "c", 5000),
    (11, "one", None, None, 3),
    (None, "no id here", "en", "a", 10),
    (13, "12345 67890 !!", "en", "z", 14),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The odd rows, with extra columns whose names the operators use inside."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    extra = ["fp", "label", "span", "part", "size", "n", "block", "copies", "table", "key", "token", "fold", "slot", "shard", "media", "_id", "_copies"]
    return frame.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
