import pytest

#: Rows that every operator on documents must take: nulls, empty and blank texts, ties, repeated rows, repeated ids.
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 3000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The same long line that several documents have\nown line five"),
    (6, "The same long line that several documents have\nown line six"), (7, "the SAME long line that several documents have  \n\n"), (7, "the SAME long line that several documents have  \n\n"),
    (None, "The same long line that several documents have"), (8, LONG), (9, LONG + "x"), (10, "1234 5678 !!! ???"), (11, "é漢字🙂 ﬁ ﷺ"), (12, "x" * 5000), (5, "another text with the id five"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with further columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, line_dedup string, same string, fp string, component string, shingles string, kept string, _id string"
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in ODD]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def texts():
    return [(i, t or "") for i, t in ODD]


