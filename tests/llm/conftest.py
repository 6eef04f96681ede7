import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, items string"


@pytest.fixture
def make(spark):
    """Documents from (id, text, lang, source) with columns whose names clash with those the operators use inside."""

    def build(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], SCHEMA)

    return build


#: Null in every column, empty and blank texts, a long text, repeated rows and ids.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "some words without an id here", "en", None),
    (None, None, None, None), (4, "same text twice for one id", "en", "b"), (4, "same text twice for one id", "en", "b"),
    (4, "another text of that id", "de", "b"), (5, "x" * 60_000, "en", "a"), (6, "long " * 30_000, "de", "c"),
]
