import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Row int, SCORE string, spans string, place int, fp string, deal int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977} the of {i}" for i in range(20_000))
    texts = [(1, "The cat and the dog of a house."), (2, None), (3, ""), (4, long), (5, "The cat and the dog of a house."), (5, "The cat and the dog of a house."), (None, "no id"), (7, "\u00e9\u00df \U0001f600\u0130 \x00 \t\n"), (8, "!!!"), (9, "x")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, 1, "s", None, 2, None, 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
