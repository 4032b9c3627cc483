import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, docs_schema):
    """Nulls in every column, empty and blank texts, ties, repeated rows, long texts."""
    rows = [(1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, " \t\n ", "en", "b", 4), (5, "The quick brown fox jumps over the lazy dog", "en", None, 43),
            (5, "The quick brown fox jumps over the lazy dog", "en", None, 43), (None, "No id at all here", "en", "b", 17),
            (7, "Wort für Wort geht es weiter und weiter", "de", "b", 39), (8, "ab " * 30_000, "en", "c", 90_000),
            (9, "x" * 5_000, None, "c", 5_000), (10, "ÄÖ ÜÉ 日本 😀 ok", "de", "c", 13)]
    return spark.createDataFrame(rows, docs_schema)
