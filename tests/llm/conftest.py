import pytest

DATA = "/root/testdata/sf0.01"

LONG = "the quick brown fox " * 20_000
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, LONG),
    (5, "one two"),
    (6, "one two"),
    (6, "one two"),
    (None, "one two"),
    (7, "Straße ЁЖ 漢字漢字漢字漢字漢字漢字 \U0001f600 é"),
    (8, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names clash with the operators' own."""
    rows = [(d, t, "x", 1.5, "y") for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, score double, kept string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def corpus(spark):
    """The whole small table, as rows and as a DataFrame."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
