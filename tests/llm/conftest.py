import pytest

#: A table with what operators must bear: nulls in any column, an empty text, a blank one, a long one, repeated rows, and
#: columns named like results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a", 10, 0.5, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a", 10, None, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a", 10, None, "x"),
    (3, None, None, None, None, None, None),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", None, 5, 1.0, None),
    (4, "", "en", "b", 0, 0.0, ""),
    (5, " \t\n", "de", "b", 3, 0.0, "y"),
    (6, "lang " * 40_000 + "ende", "de", "c", 200_000, 0.0, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rule string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def _intermediate_tables_go(spark):
    yield
    from kairoline.llm.common import clean_up

    clean_up(spark)
