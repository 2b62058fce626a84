import pytest

EDGES = [(10, None), (11, ""), (12, " \n\t"), (13, "one"), (14, "one"), (14, "one"), (None, "two words"), (15, "x" * 70_000), (16, "word " * 30_000), (17, "ÄÖ ß é 😀 ▁ \x00 end")]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated ids, and columns whose names clash with results."""
    rows = [(i, t, "en", "src0", 1, "mine", 7) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id int")


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
