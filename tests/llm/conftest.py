import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, n int, w string"

#: Nulls, empties, ties, repeated rows, a very long text, and columns whose names the operators use inside.
ODD = [
    (1, "", None, None, None, 1, 1, "x"), (2, None, "en", "a", 3, None, None, None), (3, "one two", None, None, 7, 2, 2, "y"),
    (4, "Mail bob@site.org or +1 (743) 555-3824 now; card 4111 1111 1111 1111, host 10.0.0.255.", "en", "a", 1, 1, 1, "z"),
    (4, "Mail bob@site.org or +1 (743) 555-3824 now; card 4111 1111 1111 1111, host 10.0.0.255.", "en", "a", 1, 1, 1, "z"),
    (5, "x " * 30000, "en", "a", 1, 1, 1, "z"), (None, "a row without an id here", "en", "a", 1, 1, 1, "z"), (6, "x " * 30000, "en", "a", 1, 1, 1, "z"),
    (7, "\n\n\t ", None, None, 0, 0, 0, ""), (8, "tie tie tie tie tie tie tie tie", "en", "a", 1, 1, 1, "z"), (9, "tie tie tie tie tie tie tie tie", "en", "a", 1, 1, 1, "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
