"""Fixtures of awkward documents."""

import pytest

#: Nulls, empty and blank texts, repeats, ties, a long text, columns with clashing names.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "size", 3),
    (2, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", None),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", None, "b", 1),
    (6, "word", "en", "b", 1),
    (7, "über straße   schön\n\nÉtudier été à ▁ la plage  ", "de", "b", 1),
    (8, "x" * 50_000 + " y" * 20_000, "en", "b", 1),
    (9, "🙂 \u0000 control ​ zero", "fr", "b", 1),
    (9, "🙂 \u0000 control ​ zero", "fr", "b", 1),
    (None, "no id here at all", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, slot string, shard int"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
