"""Documents that every operator has to handle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 30_000
EXTRA = (
    "size", "taken", "kept", "n_words", "score", "secrets", "n_lines", "host", "bands", "list", "pack_part", "held_out",
    "predicted", "place", "rank", "id", "n", "block", "pairs", "key", "weight", "shared",
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ids with several texts and clashing columns."""
    data = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (None, "one two three", "en", "a", 13),
        (3, LONG, "en", "a", len(LONG)),
        (4, LONG, "fr", "b", len(LONG)),
        (5, "one two three four five six", "en", None, 27),
        (5, "one two three four five six", "en", None, 27),
        (5, "another text with the same id as above", "en", None, 27),
        (6, "ONE two\tthree\nfour five six", "xx", "c", 27),
        (7, " \n\t ", "en", "c", 4),
        (8, "é ü 😀 z <|endoftext|> <s> ▁x \x00 y", "de", "c", 8),
        (2**62 + 1, "x " * 25, "en", "c", 50),
    ]
    return spark.createDataFrame(data, DOC).withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
