import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = " ".join(f"word{i % 97} the{i % 13}" for i in range(90)) + "."
OTHER = " ".join(f"term{i} of{i % 7}" for i in range(80)) + "."


def edge_rows():
    """Nulls in every column, empty and long texts, equal texts, repeated rows and ids that repeat."""
    texts = [
        (1, PROSE, "en", "a"),
        (2, PROSE + " " + OTHER, "en", "a"),
        (2, PROSE + " " + OTHER, "en", "a"),
        (2, OTHER, None, None),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (5, " \t\n ", None, "b"),
        (None, PROSE, "en", None),
        (None, None, None, None),
        (6, "ſ é 漢字 \x00 <|endoftext|> ▁ x  y", "xx", "c"),
        (7, "ab " * 30_000, "en", "a"),
        (8, "x" * 5_000, "en", "a"),
        (9, "line one here\nline one here\n\nline one here", "fr", "a"),
        (10, PROSE, "en", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    """Columns named like those that the operators make."""
    names = "fp key row own cover kept n_words n_removed kept_text component_id language posterior band label at id part role vote"
    return edge.withColumns({name: F.lit("mine") for name in names.split()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
