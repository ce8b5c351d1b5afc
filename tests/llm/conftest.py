from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, kept boolean, component_id string, slot string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long_text = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 9, True, "q", "s"), (2, "alpha beta gamma delta epsilon zeta", "en", "a", None, None, None, None, None, None),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None, None), (4, "", "en", "b", 0, "", 0, False, "", ""),
        (None, "no id here at all", "de", "b", 3, "y", 1, True, "c", "d"), (None, None, None, None, None, None, None, None, None, None), (5, long_text, "en", "a", 5, "z", 2, True, "e", "f"),
        (6, long_text + " end", "en", "a", 5, "z", 2, True, "e", "f"), (7, " \t\n ", "fr", "b", 5, "z", 2, True, "e", "f"), (8, "ALPHA beta", "en", "c", 5, "z", 2, True, "e", "f"), (9, "Été à la 你好 😀.", "fr", "c", 5, "z", 2, True, "e", "f"),
    ]
    return spark.createDataFrame(rows, SCHEMA)
