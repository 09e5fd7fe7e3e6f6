import pytest

FOLDER = "/root/testdata/sf0.001"

EDGE = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t\n ", "b"),
    (4, "one", "b"),
    (4, "one", "b"),
    (None, "The same line of text here\nand another one", "c"),
    (5, "the same line of text here  \nnot seen elsewhere at all", "c"),
    (6, "\tTHE SAME LINE OF TEXT HERE\n\nshort\nshort", "c"),
    (7, "word " * 3000 + "end", "d"),
    (8, "é" * 5000 + " 漢字 \x1c x", "d"),
    (9, " ".join(f"w{i}" for i in range(60)), "e"),
    (10, " ".join(f"w{i}" for i in range(60)), "e"),
    (11, " ".join(f"w{i}" for i in range(2, 62)), "e"),
    (12, "a\x00b <|endoftext|> c  d\r\n", "e"),
]


@pytest.fixture
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like results."""
    rows = [(i, t, s, "x", 0, True) for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, n_lines int, kept boolean")


@pytest.fixture
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
